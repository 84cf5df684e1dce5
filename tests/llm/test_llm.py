"""Edge cases and brute-force versions of the operators of the llm package."""

import random
import re
import zlib
from math import log10

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, id int, size int, dk string, part int, n int"


def make(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1, 2, "d", 3, 4) for i, t, s in rows], DOCS)


def lowered(t):
    return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def corpus():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 60))) + ("\n" + " ".join(rng.choices(vocab, k=12))), "s%d" % (i % 4)) for i in range(60)]
    for i in range(60, 80):  # near and exact copies, in chains
        words = rows[i - 40][1].split(" ")
        words[rng.randrange(len(words))] = "new%d" % (i % 3)
        rows.append((i, " ".join(words), "s0"))
    rows += [(80, None, None), (81, "", "s1"), (82, " \n\t ", "s1"), (83, "One two", "s9"), (84, "one  TWO", "s9"), (85, "x " * 30_000, "s2"), (5, rows[5][1], "s1"), (None, "a null id here now", "s1")]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS).cache()


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    from meridex.llm.tokens import token_counts

    path = P.path("byte_bpe_50k.json")
    odd = [(1, " a  b\t<|endoftext|> x<|endoftext|>\ny ² don't ½ Σς x.. ,,a\n\n b", "s"), (2, "it's we'll Été,.. naïve!? ΣΑΣ.  z ", "s")]
    tok = Tokenizer.from_file(path)
    for d, rows in ((docs, ROWS), (make(spark, odd), odd), (docs.limit(0), [])):
        got = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(d, path, P.PATTERN).collect())
        want = []
        for i, t, _ in rows:
            n = len(tok.encode(t or "", add_special_tokens=False).ids)
            want.append((i or -1, len((t or "").encode()), n, n > 1024))
        assert got == sorted(want)


def test_packing(spark, store, docs):
    from tokenizers import Tokenizer

    from meridex.llm.packing import best_fit, lower_bound, pack_documents

    path = P.path("word_bpe_49k.json")
    tok, want = Tokenizer.from_file(path), []
    for i, t, _ in ROWS:
        a = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i or -1, k // 2048, k, len(a[k : k + 2048]), zlib.crc32(a[k : k + 2048].tobytes())) for k in range(0, len(a), 2048)]
    got = pack_documents(docs, path, store).collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in seqs.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048
    assert len(seqs) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert pack_documents(docs.limit(0), path, store).count() == 0
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(1, 101, 60)
        bins, offs, used = best_fit(n, 100)
        assert lower_bound(n, 100) <= used and max(np.bincount(bins, weights=n)) <= 100
    assert lower_bound(np.array([60, 60, 60]), 100) == 3


def test_jaccard(spark, store, docs):
    from meridex.llm.jaccard import choose_boundary, jaccard_components, keep_one

    small = [(100 + i, t, "s") for i, t in enumerate(["a b c d e f g h i j", "a b c d e f g h i", "b c d e f g h i j", "q r s t u", "Q r s t u", "q r s t"])]
    rows = [*ROWS, *small]
    d = make(spark, rows)
    sets = [frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])) for w in (lowered(t) for _, t, _ in rows)]
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, _, _) in enumerate(rows):
        for y, (j, _, _) in enumerate(rows[:x]):
            k = len(sets[x] & sets[y])
            if i is not None and j is not None and k and 100 * k >= 80 * (len(sets[x]) + len(sets[y]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for (i, _, _), s in zip(rows, sets, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard_components(d, store).collect()) == want
    assert jaccard_components(d.limit(0), store).count() == 0
    kept = keep_one(d, store)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in want if c >= 0} | {None}
    assert choose_boundary({12: 100}, 1.0, 80, 100) < 12 <= choose_boundary({12: 100}, 1e6, 80, 100)


def test_subset_keys_join_small_sets(spark, store, monkeypatch):
    from meridex.llm import jaccard

    rng = random.Random(9)
    rows = []
    for i in range(120):
        w = list("abcdefghijklm")[: rng.randint(3, 13)]
        if rng.random() < 0.6:
            w[-1] = rng.choice("xyz")
        rows.append((i, " ".join(w), "s"))
    d = make(spark, rows)
    plain = sorted(map(tuple, jaccard.jaccard_components(d, store).collect()))
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *_: 6)
    assert sorted(map(tuple, jaccard.jaccard_components(d, store).collect())) == plain


def test_jaccard_crowds(spark, store, monkeypatch):
    """A passage that many share without being linked, and many near copies of one text, through hub rounds."""
    from meridex.llm import jaccard

    rng = random.Random(3)
    passage, base = ["p%d" % i for i in range(40)], ["b%d" % i for i in range(60)]
    texts = [passage + ["q%d_%d" % (i, k) for k in range(i % 11)] for i in range(60)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(60)] = "e%d" % rng.randrange(1000)
        texts.append(w)
    monkeypatch.setattr(jaccard, "HEAVY_LEAST", 4)
    monkeypatch.setattr(jaccard, "HUB_LEAST", 0)
    monkeypatch.setattr(jaccard, "HUB_FRUIT", 10**9)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in texts]
    comp = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            k = len(sets[x] & sets[y])
            if 100 * k >= 80 * (len(sets[x]) + len(sets[y]) - k) and comp[x] != comp[y]:
                lo, hi = sorted((comp[x], comp[y]))
                comp = [lo if c == hi else c for c in comp]
    got = jaccard.jaccard_components(make(spark, [(i, " ".join(w), "s") for i, w in enumerate(texts)]), store)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(comp))


def test_jaccard_one_id_with_two_texts(spark, store):
    """Rows that share a doc_id are each linked by their own text."""
    from meridex.llm import jaccard

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a, "s"), (5, b, "s"), (7, a + " more", "s"), (3, b + " more", "s"), (5, "a text of its own that stands alone", "s"), (9, a, "s")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(spark, rows), store).collect())
    assert got == sorted([(5, 56, 5), (5, 56, 3), (7, 57, 5), (3, 57, 3), (5, 4, 5), (9, 56, 5)])


def test_odd_sketches_keep_every_link():
    """No pair of sets at the threshold is ruled out, whatever the sizes; sets that share half are."""
    import pyarrow as pa

    from meridex.llm import jaccard

    rng = np.random.default_rng(2)
    apart = 0
    for n in [1, 2, 5, 9, 31, 64, 85, 86, 300, 2000]:
        for _ in range(40):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            change = int(rng.integers(0, n + 1))
            y = np.unique(np.concatenate([x[change:], rng.integers(0, 2**63, int(rng.integers(0, change + 1))).astype(np.uint64)]))
            if not len(y):
                continue
            odd = jaccard.odd_sketches(np.concatenate([x, y]), np.array([len(x), len(y)]))
            one = pa.array([1], pa.int64())
            pair = pa.RecordBatch.from_arrays([one, one, pa.array([len(x)], pa.int32()), pa.array([len(y)], pa.int32()), odd[:1], odd[1:]], names=["a", "b", "na", "nb", "odd_a", "odd_b"])
            kept = next(jaccard._may_link(80, 100)([pair])).num_rows
            both = len(np.intersect1d(x, y))
            linked = 100 * both >= 80 * (len(x) + len(y) - both)
            assert kept or not linked
            apart += not kept
    assert apart > 100


def test_jaccard_lists_in_parts(spark, store, monkeypatch):
    """A near copy of many exact copies: two classes, alone in the parts of the lists where they meet."""
    from meridex.llm import jaccard

    rows, want = [], {}
    for g in range(12):
        w = ["g%dw%d" % (g, k) for k in range(60)]
        for k in range(21):
            rows.append((100 * g + k, " ".join(w if k else [*w[:-1], "other"]), "s"))
            want[100 * g + k] = 100 * g
    monkeypatch.setattr(jaccard, "HEAVY_LEAST", 4)
    monkeypatch.setattr(jaccard, "LIST_TASK", 8)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(make(spark, rows), store).collect()} == want


def test_mixing(spark, store, docs):
    from meridex.llm.mixing import mix, mix_rows, schedule, targets

    got = mix(docs, store).collect()
    assert len(got) == len(ROWS)
    sizes, by = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    names = sorted(k for k in sizes if k is not None) + [None]
    w, cap = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 2.0 * sizes[s] for s in names}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:  # the excess is reshared until none is above its cap
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        want |= {s: cap[s] for s in over} | {s: share[s] for s in open_ - over}
        if not over:
            break
        left -= sum(cap[s] for s in over)
        open_ -= over
    for s, (taken, target) in by.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= max(2, 0.01 * target)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(7), store).collect()))
    per = targets(mix(docs, store).select("doc_id", "source", "size"))
    s = schedule(spark, per).orderBy("slot").collect()
    assert max(abs(sum(1 for r in s[:k] if r.source == "s2") / k - sum(1 for r in s if r.source == "s2") / len(s)) for k in range(len(s) // 4, len(s), 50)) < 0.05
    assert mix(docs.limit(0), store).count() == 0
    out = mix_rows(docs, store)
    assert out.columns == docs.columns and out.count() > 0


def test_lines(spark, store, docs):
    from meridex.llm.lines import dedup_lines, normalise

    a = "the quick brown fox jumps over the lazy dog while seven other animals watch it from the far side of the old wooden fence"
    rows = [(1, f"{a}\nshort line", "s"), (2, f"{a.upper()}!!\nshort line\nnothing else is like this one at all", "s"), (3, a.replace("quick", "quick 12"), "s"),
            (4, None, "s"), (5, "", "s"), (6, "a b c d e\na b c d e", "s"), (None, a, "s"), (7, a.replace("wooden", "woodem"), "s")]
    d = make(spark, rows)
    got = {r.doc_id: r for r in dedup_lines(d, store).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "nothing else is like this one at all" and got[3].text == "" and got[None].text == ""
    assert got[4].text is None and got[4].n_lines == 0 and got[5].text == "" and got[6].text == "a b c d e" and got[6].n_removed == 1
    assert dedup_lines(d.limit(0), store).count() == 0
    seen, want = set(), 0
    for i, t, _ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        for line in [] if i == 5 and t in seen else (t or "").split("\n"):
            n = normalise(line)
            n = n if len(n.split()) >= 5 else " ".join(line.lower().split())
            want += bool(n) and n in seen
            seen.add(n)
        seen |= {t} if i == 5 else set()
    out = dedup_lines(docs, store)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.agg({"n_removed": "sum"}).first()[0] >= want


def test_lines_that_differ_in_numbers(spark, store):
    """Numbers count as much as letters: other numbers make another line, one other digit a near copy."""
    from meridex.llm.lines import dedup_lines

    rows = [(1, "in 2019 the total was 345 and in 2020 it was 678", "s"), (2, "in 1999 the total was 1 and in 1998 it was 2", "s"),
            (3, "In 2019, the total was 345; and in 2020 it was 679!", "s"), (4, "in the total was and in it was", "s")]
    got = {r.doc_id: r.text for r in dedup_lines(make(spark, rows), store).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "", 4: rows[3][1]}


def test_lines_without_words(spark, store):
    """Scripts without blanks, and lines of digits and marks."""
    from meridex.llm.lines import dedup_lines

    rng = random.Random(6)
    han, thai = ("".join(chr(rng.randrange(*r)) for _ in range(80)) for r in ((0x4E00, 0x9000), (0x0E01, 0x0E2F)))
    digits = " ".join(str(rng.randrange(1000, 9999)) for _ in range(12))
    lines = [han, thai, digits, "id " + digits, digits[:-1] + "x", "1 2 3", "\u4e2d\u6587"]
    near = han[:40] + "\u4e00" + han[41:]
    rows = [(1, "\n".join(lines), "s"), (2, "\n".join(lines), "s"), (3, near, "s"), (4, digits[::-1], "s"), (5, digits.replace(" ", "  "), "s")]
    got = {r.doc_id: r.text for r in dedup_lines(make(spark, rows), store).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "", 4: digits[::-1], 5: ""}


def test_near_lines(spark, store):
    """Lines with typing errors and changed words, up to the edit similarity asked for, against brute force."""
    from meridex.llm.lines import dedup_lines

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            prev, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, prev + (x != y))
        return row[-1]

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz\u00e9", k=rng.randint(2, 10)))
    rows, near = [], set()
    for i in range(300):
        line = " ".join(word() for _ in range((8, 15, 30, 60)[i % 4]))
        other = list(line)
        if i % 3:
            for k in rng.sample([k for k, c in enumerate(line) if c != " "], int(len(line) * (0.03, 0.06, 0.095)[i // 4 % 3])):
                other[k] = rng.choice("abcdefghij")
            other = "".join(other)
        else:
            other = line.split(" ")
            for _ in range(1 + len(other) // 20):
                other[rng.randrange(len(other))] = word()
            other = " ".join(other)
        rows += [(i, line, "s"), (1000 + i, other, "s")]
        if distance(line, other) <= 0.1 * max(len(line), len(other)):
            near.add(1000 + i)
    gone = {r.doc_id for r in dedup_lines(make(spark, rows), store).where("n_removed > 0").collect()}
    assert len(near) > 200 and gone <= near
    assert len(gone) >= 0.95 * len(near)


@pytest.mark.parametrize("words", [(5, 9), (10, 19), (20, 59), (60, 300)])
def test_near_lines_of_one_letter(spark, store, words):
    """One letter changed, by length of the line."""
    from meridex.llm.lines import dedup_lines

    rng = random.Random(words[0])
    rows = []
    for i in range(100):
        line = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(rng.randint(*words)))
        k = rng.choice([k for k, c in enumerate(line) if c != " "])
        rows += [(i, line, "s"), (1000 + i, line[:k] + ("x" if line[k] != "x" else "y") + line[k + 1 :], "s")]
    assert dedup_lines(make(spark, rows), store).where("n_removed > 0 and doc_id >= 1000").count() >= 90


def test_edit_distance(monkeypatch):
    from meridex.llm import lines

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            prev, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, prev + (x != y))
        return row[-1]

    rng = random.Random(12)
    xs, ys = [], []
    for _ in range(1500):
        a = "".join(rng.choices("ab\u4e2d ", k=rng.randint(0, 250)))
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choices("abc", k=rng.randint(0, 2))
        xs.append(a)
        ys.append("".join(b))
    want = [plain(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9) for a, b in zip(xs, ys, strict=True)]
    assert 300 < sum(want) < 1300 and lines.alike(xs, ys).tolist() == want
    monkeypatch.setattr(lines, "WIDE", 0)
    assert lines.alike(xs, ys).tolist() == want


def test_pitman_yor(spark, store, docs):
    from meridex.llm.pitman_yor import log_stirling, score_documents, seat

    toks = [(i, [*lowered(t), "\0"]) for i, t, _ in ROWS]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in toks]
    c = {}
    for (_, ws), h in zip(toks, held, strict=True):
        for w in ws if not h else []:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    got = sorted(score_documents(docs, store).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
    assert got == sorted(score_documents(docs, store).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
    want = sorted(((i or -1, len(ws), h, sum(w in c for w in ws), n, sum(log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws)) for (i, ws), h in zip(toks, held, strict=True)))
    for r, w in zip(got, want, strict=True):
        assert ((r.doc_id or -1), r.n_tokens, r.held_out, r.n_known, r.train_tokens) == w[:5] and r.base_score == pytest.approx(w[5]) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert score_documents(docs.limit(0), store).count() == 0
    t = seat(np.array([0, 1, 2, 30, 5000]), np.full(5, 0.5), 0.5, np.arange(5, dtype=np.uint64))
    assert t[0] == 0 and t[1] == 1 and all(1 <= x <= k for x, k in zip(t[2:], (2, 30, 5000), strict=True))
    assert np.exp(log_stirling(4, 0.5)[3, 1:4]) == pytest.approx([0.75, 1.5, 1.0])


def test_pitman_yor_does_not_depend_on_partitions(spark, store, docs, monkeypatch):
    """Scores are the same over other partitions, buckets and lists of hot words."""
    from meridex.llm import pitman_yor

    key = lambda r: (r.doc_id or -1, r.n_tokens, r.base_score)
    want = sorted(pitman_yor.score_documents(docs, store).collect(), key=key)
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(pitman_yor, "HOT_SHARE", 0.05)
    got = sorted(pitman_yor.score_documents(docs.repartition(7), store).collect(), key=key)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert np.allclose([[r.score, r.base_score] for r in got], [[r.score, r.base_score] for r in want], rtol=1e-9)


def test_pitman_yor_adds_up_to_one():
    """The predictive probability over a context's words, the other words and the unseen one, with a hot word and without."""
    from meridex.llm import _kit as K
    from meridex.llm import pitman_yor as py

    rng = np.random.default_rng(5)
    w = np.sort(K.mix(np.arange(40, dtype=np.uint64)))
    per = rng.integers(1, 30, 40)
    ctx = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in per]).astype(np.uint16)
    c = rng.geometric(0.1, len(ctx))
    r = {"bucket": 0, "w": py._zip(w), "per": py._zip(per.astype(np.uint32)), "ctx": py._zip(ctx), "c": py._zip(c.astype(np.uint32))}
    for hot in (w[:0], w[3:5]):
        history = []
        for _ in range(py.SWEEPS + 1):
            history.append(py.collected(*py.sums(r, history, hot), hot, history))
        assert all(40 <= g["T0"] <= g["C0"] <= c.sum() for g in history)
        p, _, p0 = py.predictive(r, history, hot)
        word = np.repeat(np.arange(40), per)
        each = np.array([p0[word == k][0] for k in range(40)])
        samples = range(py.SWEEPS + 1 - py.SAMPLES, py.SWEEPS + 1)
        unseen = np.mean([py.root_probability(np.zeros(1), np.zeros(1), history[k])[0] for k in samples])
        assert each.sum() + unseen == pytest.approx(1)
        for x in range(50):
            total = p[ctx == x].sum()
            for k in samples:
                g, d1 = history[k], history[k - 1]["d1"]
                away = 1 - sum(_root(py, r, history, hot, k)[word[ctx == x]])
                total += (py.STRENGTH + d1 * g["t"][x]) * away / (py.STRENGTH + g["c"][x]) / py.SAMPLES
            assert total == pytest.approx(1)


def _root(py, r, history, hot, k):
    *_, is_hot, where, states = py._restaurants(r, history[:-1], hot)
    _, root, t0 = states[k]
    root, t0 = root.copy(), t0.copy()
    root[is_hot], t0[is_hot] = history[k]["hot_t"][where], history[k]["hot_t0"][where]
    return py.root_probability(root, t0, history[k])


def test_toxicity(spark):
    from meridex.llm.toxicity import clean, toxicity

    rng = random.Random(2)
    vocab = ["word" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] for i in range(100)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        ws = rng.choices(vocab, k=rng.randint(5, 80)) + (rng.choices(["vileword", "nastyone", "grimthing"], k=3) if bad else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), "s"))
        labels.append((i, int(bad), 1))
    rows += [(600, None, "s"), (601, "", "s"), (0, rows[0][1], "s")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1)], "doc_id bigint, toxic int, text int")
    d = make(spark, rows)
    got = {r.doc_id: r for r in toxicity(d, lab).collect()}
    assert len(got) == 602 and toxicity(d, lab).count() == 603
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(600))
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[600].predicted == got[601].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity(d, lab.limit(0)).where("predicted = 0").count() == 603 and toxicity(d.limit(0), lab).count() == 0
    assert clean(d, lab).columns == d.columns


def test_vectors(spark):
    from meridex.llm.vectors import exact_topk, permutation_search

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[200:230] = x[0]  # ties
    rows = [(i, v.tolist(), 7, 1) for i, v in enumerate(x)]
    rows += [(500, None, 7, 1), (550, [1.0, None] * 8, 7, 1), (600, [float("nan")] * 16, 7, 1), (None, x[0].tolist(), 7, 1), (650, [0.0] * 16, 7, 1), (3, x[3].tolist(), 7, 1), (700, [1.0, 2.0], 7, 1)]
    emb = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int, dim int")
    full = np.vstack([x, np.zeros((1, 16))]).astype(float)
    ids = np.array([*range(400), 650])
    q = np.floor(full * 256).astype(int)
    got = {}
    for r in exact_topk(emb).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for a in np.flatnonzero(ids % 50 == 0):
        s = q @ q[a]
        best = [j for j in np.lexsort((ids, -s)) if j != a][:5]
        assert [got[ids[a]][k + 1] for k in range(5)] == [(ids[j], s[j]) for j in best]
    assert 500 not in got and 700 not in got and exact_topk(emb.limit(0)).count() == 0
    near = {}
    for r in permutation_search(emb).collect():
        near.setdefault(r.query_id, []).append(r.vec_id)
    norm, hit = np.linalg.norm(x.astype(float), axis=1), 0
    for a in range(0, 400, 50):
        s = x.astype(float) @ x[a].astype(float) / (norm * norm[a])
        hit += len({j for j in np.lexsort((np.arange(400), -s)) if j != a and True} & set(near[a])) and len(set([j for j in np.lexsort((np.arange(400), -s.round(12))) if j != a][:5]) & set(near[a]))
    assert hit >= 0.9 * 40 and 650 not in near and permutation_search(emb.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_permutation_index_recall(spark, spread):
    """Recall on 16,384 vectors, far more than a query reranks: random ones, and ones around centres."""
    from meridex.llm import vectors

    rng = np.random.default_rng(11)
    n = 16384
    x = rng.normal(size=(n, 32)) + spread * rng.normal(size=(64, 32))[rng.integers(0, 64, n)]
    emb = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
    near = {}
    for r in vectors.permutation_search(emb, every=256).collect():
        near.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for a in range(0, n, 256):
        s = unit @ unit[a]
        s[a] = -2
        assert [r for r, _ in sorted(near[a])] == [1, 2, 3, 4, 5]
        hit += len(set(np.argsort(-s)[:5].tolist()) & {v for _, v in near[a]})
    assert vectors.SHARE * n < n / 4 and hit >= 0.9 * 5 * len(near) and len(near) == n // 256, hit / 5 / len(near)


def test_html(spark):
    from meridex.llm.html import Wrapper, extract, main_text

    page = lambda k, body: f"<!DOCTYPE html><html><head><title>T{k}</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>menu</a></li><li>b</li></ul></nav><div class='cookie-notice'>ok?</div><article><h1>Head {k}</h1>{body}<form>mail <input></form></article><div class=\"comments\"><p>said</p></div><footer>&copy; me</footer></body></html>"
    rows = [(1, "http://a.example/1", page(1, "<p>One &amp;\n  two<p>three <b>x</b>y")), (2, "http://a.example/2", page(2, "<p>q</p>")), (3, "http://b.example/", "<div id=top><p>Lone text of some length here.</p></div>"), (4, None, None), (5, "x", ""), (1, "http://a.example/1", page(1, "<p>cut <b>of"))]
    d = spark.createDataFrame([(*r, "h", "w") for r in rows], "page_id bigint, url string, html string, host string, wrapper string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_text(d).collect())
    assert got[0][1] == "Head 1\nOne & two\nthree xy" and got[1][1] == "Head 1\ncut of"
    assert [g[1] for g in got[2:]] == ["Head 2\nq", "Lone text of some length here.", "", ""] and all(len(t) == n for _, t, n in got)
    assert main_text(d.limit(0)).count() == 0
    w = Wrapper.of_page("<ul><li>a</li><li>b</li></ul>")
    w.align(Wrapper.of_page("<ul><li>a</li><li>c</li></ul><p>x</p>"))
    assert w.expression() == "<ul>(<li>#</li>)+</ul>(<p>)?(#)?(</p>)?"
    assert extract("<article><p>x</article>", Wrapper.of_page("<article><p>x</article>").dumps()) == "x"


def test_html_mixed_templates(spark):
    """Pages with and without an article on one host, and texts that the wrapper does not match."""
    from meridex.llm.html import Wrapper, extract, main_text

    art = "<body><nav>menu</nav><article><p>Text %d of an article</p></article></body>"
    div = "<body><nav>menu</nav><div id=text><p>Plain text %d, in a div of its own</p></div><footer>me</footer></body>"
    rows = [(k, url, (div if k % 5 == 0 else art) % k) for k, url in enumerate(["http://a.example/x"] * 10 + ["no host"] * 6)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: ("Plain text %d, in a div of its own" if k % 5 == 0 else "Text %d of an article") % k for k, *_ in rows}
    assert extract("<article><p>x</p><ul><li>y</li></ul></article>", Wrapper.of_page("<article><h1>a</h1></article>").dumps()) == "x\ny"
    assert extract("<div><p>x</p><h2>y</h2></div><nav>z</nav>", Wrapper.of_page("<div><p>a</p></div>").dumps()) == "x\ny"


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1)], "doc_id bigint, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.length <= 2048 for r in got)


def test_html_names_and_quotes():
    """Names of elements in an article, and attributes that nothing closes."""
    from meridex.llm.html import Wrapper, extract

    for html, want in [
        ('<article class="related-story"><p>Text</p></article>', "Text"),
        ('<article><section class="side-effects"><p>Text</p></section></article>', "Text"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Text</p></article>', "Title\nText"),
        ('<article><p>Text</p><div class="cookie-notice">no</div><div class="comments">no</div></article>', "Text"),
        ('<article><p title="a>Hello</p><p>Text</p></article>', "Hello\nText"),
        ("<article><p>Text", "Text"),
        ("<article>" + "<div>" * 3000 + "Text" + "</div>" * 3000 + "</article>", "Text"),
    ]:
        assert extract(html, Wrapper.of_page(html).dumps()) == want


def test_letters_keep_every_similar_pair():
    from meridex.llm import lines

    rnd = np.random.default_rng(3)
    some = list("abcdefghij klmé漢")
    xs, ys = ["", "a" * 400], ["", "a" * 390]
    for _ in range(1500):
        x = list(rnd.choice(some, rnd.integers(10, 300)))
        y = list(x)
        for _ in range(rnd.integers(0, max(2, len(x) // 7))):
            k = int(rnd.integers(0, max(1, len(y))))
            y[k : k + int(rnd.integers(0, 2))] = list(rnd.choice(some, rnd.integers(0, 2)))
        xs.append("".join(x))
        ys.append("".join(y))
    place = pa.array(range(len(xs)))
    pairs = pa.RecordBatch.from_arrays([place, place, lines._letters(pa.array(xs)), lines._letters(pa.array(ys))], names=["a", "b", "x", "y"])
    kept = set(next(lines._near([pairs])).column("a").to_pylist())
    similar = set(np.flatnonzero(lines.alike(xs, ys)).tolist())
    assert len(similar) > 500 and similar <= kept
    far = pa.RecordBatch.from_arrays([place[:1], place[:1], lines._letters(pa.array(["one two three four"])), lines._letters(pa.array(["five six seven nine"]))], names=["a", "b", "x", "y"])
    assert next(lines._near([far])).num_rows == 0


def _alone(html):
    from meridex.llm.html import Wrapper, extract

    return extract(html, Wrapper.of_page(html).dumps())


@pytest.mark.parametrize("name", "comment-list comments-section related-posts share-buttons ad-container ad-slot newsletter-box cookie-bar promo-box social-links breadcrumb-list sidebar-left pagination-links login-form commentArea relatedPosts".split())
def test_html_names_in_an_article(name):
    """Names that say only what stands outside, and its shape."""
    assert _alone(f"<body><article><h1>Head</h1><p>Some text.</p><div class='{name}'><p>junk</p></div><p>End.</p></article></body>") == "Head\nSome text.\nEnd."


@pytest.mark.parametrize("name", "side-effects share-price related-work social-history notice-period search-algorithm article-body post-content adsorption comment-on-method header-text list".split())
def test_html_names_that_say_more(name):
    assert _alone(f"<body><article><p>One.</p><div class='{name}'><p>kept</p></div></article></body>") == "One.\nkept"


def test_html_second_articles():
    """A reader comment and a teaser in an article of their own go; sections in articles of their own, and lists of linked articles, stay."""
    text = "<article><h1>H</h1><p>body text that is long enough to be one</p></article>"
    assert _alone(f"<main>{text}<article class='comment'><p>I disagree</p></article></main>") == "H\nbody text that is long enough to be one"
    assert _alone(f"<main>{text}<article><h3><a href=/x>Other</a></h3><p>short</p></article></main>") == "H\nbody text that is long enough to be one"
    assert _alone(f"<main>{text}<article><h3>Part two</h3><p>short</p></article></main>") == "H\nbody text that is long enough to be one\nPart two\nshort"
    linked = "<article><h3><a href=/x>One</a></h3><p>first of the texts</p></article><article><h3><a href=/y>Two</a></h3></article>"
    assert _alone(f"<main>{linked}</main>") == "One\nfirst of the texts\nTwo"
    assert _alone("<article class='post sidebar-layout-wide'><p>x</p></article>") == "x"
