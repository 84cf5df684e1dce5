"""Patterns against plain regular expressions, and what the field adds to them, on documents that it has not seen the like of."""

import hashlib
import random
import re
import time

import pytest

from meridex.llm.personal import KINDS, digests, luhn, pattern_spans, personal_data, variants

FIELDS = "doc_id bigint, text string, spans int, kind string, tokens int, o int"


def plain(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        out += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and total % 10 == 0 else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice(["1", "25", "255", "0", ".", ".", "@", "a", "B-", "+", " ", "-", "(", ")", "é", "_", "9", "4111111111111111", "\n"]) for _ in range(rng.randrange(25)))
        assert pattern_spans(t) == plain(t), t


def test_long_runs_are_read_once():
    t = time.time()
    for unit in ("a", "1", "1.", "@", "a@", "+1", "+1(", "1 ", "é1", "1.1.1.1."):
        pattern_spans(unit * (1 << 18))
    assert time.time() - t < 30


def planted(seed, n=200):
    rng = random.Random(seed)
    digits = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))

    def one(k):
        if k == 2:
            d = "4" + digits(14)
            return next(d + str(x) for x in range(10) if luhn(d + str(x)))
        return {0: f"{word()}.{digits(2)}@mail{digits(1)}.example.com", 1: ".".join(str(rng.randrange(1, 256)) for _ in range(4)), 3: f"+1 ({digits(3)}) 555-{digits(4)}"}[k]

    for i in range(n):  # a match and its like; a match and another's like; another's like alone; a match alone
        k, words = i % 4, [word() for _ in range(60)]
        own, case = one(k), i // 4 % 4
        like = rng.choice(variants(k, own if case == 0 else one(k)))
        words[10] = own if case != 2 else word()
        words[40] = like if case != 3 else word()
        yield " ".join(words), k, like if case == 0 else None


@pytest.fixture(scope="module")
def found(spark):
    rows = list(planted(5))
    odd = [None, "", " ", "no numbers here", "1" * 3_000, "a@b.cc " * 1000, "+1 (555) 555-0100"]
    data = [(i, t) for i, (t, _, _) in enumerate(rows)] + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "x@y.zz"), (0, rows[0][0])]
    d = spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in data], FIELDS)
    return rows, data, d, personal_data(d).collect()


def test_patterns_stay(found):
    _, data, d, got = found
    key = lambda r: (r[0] is None, r[0] or 0)
    have = sorted(((r.doc_id, [(s.start, KINDS.index(s.kind), s.end) for s in r.spans if s.base]) for r in got), key=key)
    assert have == sorted(((i, plain(t)) for i, t in data), key=key)
    texts = dict(data)
    for r in digests(d).collect():
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        said = ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= {*r.spans.split(","), ""}


def test_field_finds_likes_of_matches_alone(found):
    rows, _, _, got = found
    hits = likes = false = 0
    for r in got:
        if r.doc_id is None or r.doc_id >= len(rows):
            continue
        text, kind, like = rows[r.doc_id]
        more = [s for s in r.spans if not s.base]
        if like is None:
            false += bool(more)
        else:
            likes += 1
            at = text.rindex(like)
            hits += any(s.kind == KINDS[kind] and s.start <= at + 1 and s.end >= at + len(like) - 1 for s in more)
    assert likes >= 48 and hits >= 0.9 * likes and false <= 2


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "token 12 and 34", 1, "k", 2, 3), (2, None, 1, "k", 2, 3)], FIELDS)
    assert [(r.doc_id, r.spans) for r in personal_data(d).orderBy("doc_id").collect()] == [(1, []), (2, [])]
    assert personal_data(d.limit(0)).count() == 0
