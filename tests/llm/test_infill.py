"""Fill-in-middle against a row-by-row version."""

import hashlib
import random
import re

from meridex.llm.infill import digests, fill_in_middle

FIELDS = "doc_id bigint, text string, n int, form string, output int, h1 string, digest string"


def brute(i, t, seed=7, rate=100, spm=50):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (i, len(u), "plain", None, None, t)
    if h[3] % 100 < spm:
        return (i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows():
    rng = random.Random(2)
    odd = [None, "", "\n", "\n\n\n", "a", "é\nß\n", "x<P>y", "<", "<P", "P>\n<\nS>", "a<S\n>b", "ends <\n", "ends <S", "😀\n😀😀\n\n", "\r\n\r\n", "no break " * 50_000, "\n" * 100_000, "<M>"]
    out = [(i, t) for i, t in enumerate(odd)] + [(100 + i, t) for i, t in enumerate(odd)]
    out += [(1000 + i, "".join(rng.choice(["ab", "é", "\n", "<", "P", ">", "😀", " "]) for _ in range(rng.randrange(60)))) for i in range(300)]
    return out + [(None, "a\nb\nc"), (None, None), (7, "again\nand\n"), (7, "again\nand\n")]


def test_against_rows(spark):
    data = rows()
    d = spark.createDataFrame([(i, t, 1, "f", 2, "h", "d") for i, t in data], FIELDS)
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for rate, spm in ((100, 50), (60, 0), (0, 50)):
        got = sorted((tuple(r) for r in fill_in_middle(d, rate=rate, spm=spm).collect()), key=key)
        assert got == sorted((brute(i, t, 7, rate, spm) for i, t in data), key=key)
    assert fill_in_middle(d.limit(0)).count() == 0


def test_digests_restore_every_text(spark):
    data = rows()
    d = spark.createDataFrame([(k, t, 1, "f", 2, "h", "d") for k, (_, t) in enumerate(data)], FIELDS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in digests(d).collect():
        t = data[r.doc_id][1]
        assert r.output_sha256 == sha(brute(r.doc_id, t)[5])
        assert r.restored_sha256 == sha(t or "")
