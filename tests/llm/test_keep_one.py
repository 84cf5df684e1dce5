"""Which document of a group of near duplicates stays, where ids are shared, repeated or missing."""

import random

from meridex.llm.jaccard import keep_one

FIELDS = "doc_id bigint, text string, _own int, rank int, source string"


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Groups of distinct (doc_id, text) under links of 0.8, the least pair of each with words; the rest as they are."""
    docs = sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    s, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for k, d in enumerate(docs):
        groups.setdefault(find(k), []).append(d)
    return groups, [r for r in rows if r[0] is None]


def check(spark, store, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], FIELDS)
    got = sorted(((r.doc_id, r.text) for r in keep_one(df, store).collect()), key=str)
    groups, without = brute(rows)
    assert len(got) == len(groups) + len(without) and [g for g in got if g[0] is None] == sorted(without, key=str)
    for g in groups.values():
        stayed = [x for x in got if x in g]
        assert len(stayed) == 1 and stayed[0][0] == min(i for i, _ in g)


def test_shared_ids(spark, store):
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey", "cat dog cow hen pig fox")
    check(spark, store, [(1, a), (2, a), (2, b), (3, c), (3, d)])
    df = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in [(1, a), (2, a), (2, b), (3, c), (3, d)]], FIELDS)
    assert sorted((r.doc_id, r.text) for r in keep_one(df, store).collect()) == sorted([(1, a), (2, b), (3, c), (3, d)])


def test_against_brute_force(spark, store):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 60)))) for i in range(-20, 60)]
    for _ in range(60):
        i, t = rng.choice(rows)
        w = t.split()
        w[rng.randrange(len(w))] = "new"
        rows.append((rng.choice([i, rng.randrange(-30, 90)]), " ".join(w) if rng.random() < 0.6 else t))
    rows += [(5, ""), (5, None), (6, ""), (6, ""), (None, rows[0][1]), (None, None), rows[3], rows[3]]
    check(spark, store, rows)
    assert keep_one(spark.createDataFrame([], FIELDS), store).count() == 0
