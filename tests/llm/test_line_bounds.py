"""The bound of line pairs before their distance, texts normalised at once, and lists tried in full."""

import random

import numpy as np
import pyarrow as pa

from meridex.llm import lines as L


def _edited(rng: random.Random, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out)), rng.randrange(3)
        out[k : k + 1] = {0: [rng.choice("abcdöя語 ")], 1: [out[k], rng.choice("xyzß")], 2: []}[kind]
    return "".join(out)


def test_bound_keeps_every_alike_pair_and_drops_others():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmöя語", k=rng.randint(2, 9))) for _ in range(300)]
    xs = [" ".join(rng.choices(words, k=rng.choice([2, 5, 20, 60, 200]))) for _ in range(400)] + ["ab", "", "a" * 40_000]
    ys = [_edited(rng, x, int(0.1 * len(x))) if len(x) > 5 else x for x in xs]
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(xs, ys, strict=True)]
    most = np.array([int(0.1 * len(y) + 1e-9) for _, y in pairs])
    exact = np.array([L.distance(x, y, m) <= m for (x, y), m in zip(pairs, most.tolist(), strict=True)])
    assert exact.sum() > 300 and (L.lacking(pairs) <= L.RUN * most)[exact].all()
    assert (L.alike(xs, ys) == exact).all()
    long = np.array([x.count(" ") >= 19 for x in xs[:400]])
    letters = [(x, "".join(rng.sample(x, len(x)))) for x in xs[:400]]  # equal letters at other places
    assert (L.lacking(letters) > L.RUN * (0.1 * np.array([len(x) for x in xs[:400]])))[long].all()
    assert not L.alike(*map(list, zip(*letters, strict=True)))[long].any() and L.lacking([]).shape == (0,)


def test_normalised_at_once():
    rng = random.Random(4)
    lines = ["", "  ", "ΑΣ ΟΔΟΣ", "İstanbul 12-34", "a,b;c", "…", "語 one語two", *["".join(rng.choices("aB ,.ßé語Σ1", k=30)) for _ in range(200)]]
    assert L.normalised(lines).to_pylist() == [L.normalise(x) for x in lines]


def _tried(round_, entries):
    cols = list(zip(*sorted(entries), strict=True))
    names = ["key", "chars", "id", "s0", "s1", "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
    return [r for b in L._tried(round_)([batch]) for r in b.to_pylist()]


def test_lists_are_tried_in_full_or_again():
    small = [(1, 50, i, 7, 7, i // 2) for i in range(8)]
    crowd = [(2, 50, 100 + i, 9, 9, 100 + i) for i in range(90)]
    got = _tried(0, small + crowd)
    assert {(r["a"], r["b"]) for r in got if r["crowd"] is None} == {(i, j) for i in range(8) for j in range(i + 1, 8) if i // 2 != j // 2}
    assert [r["crowd"] for r in got if r["b"] is None] == [2]
    assert len({r["a"] for r in got if r["crowd"] == 0}) == 90
    last = _tried(None, small + crowd)
    assert all(r["crowd"] is None for r in last) and len(last) == 24 + 90 * 89 // 2


def test_long_lines_of_one_language_are_no_candidates():
    """Lines of few syllables share most of their runs; only those that have them at the same places are candidates, at any length."""
    rng = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    xs = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(600)) for _ in range(60)]
    ys = [_edited(rng, x, int(0.08 * len(x))) for x in xs]

    def packed(lines):
        raw = [x.encode() for x in lines]
        z = np.cumsum([len(x) + 1 for x in raw]) - 1
        return L._packed(L.sketches(np.frombuffer(b" ".join(raw) + b" ", np.uint8), z - np.array([len(x) for x in raw]), z))

    (kx, *sx), (ky, *sy) = packed(xs), packed(ys)
    a, b = np.triu_indices(60, 1)
    assert ((kx[a] == kx[b]).any(1) & (L.agree(sx[0][a], sx[1][a], sx[0][b], sx[1][b]) >= L.PASS)).sum() < 10
    assert ((kx == ky).any(1) & (L.agree(*sx, *sy) >= L.PASS)).sum() >= 54


def test_a_crowd_is_joined_by_one_round():
    """Of entries that all agree each has a partner before it in one order, so that they make one tree but for one in LEFT."""
    n = 700
    e = np.zeros(n, L._ENTRY)
    e["key"], e["chars"], e["id"] = 7, 100, np.random.default_rng(2).permutation(10**6)[:n]
    got = L._lists(pa.table([pa.array([3], pa.int32()), pa.array([e.tobytes()])], names=["bucket", "data"])).to_pylist()
    parent = {r["id"]: r["partner"] for r in got if r["score"]}
    assert len(got) == n and len(parent) >= n - 1 - n // L.LEFT

    def root(x):
        while x in parent:
            x = parent[x]
        return x

    assert len({root(r["id"]) for r in got}) == n - len(parent)
