"""Language-model scores by a hierarchical Pitman-Yor model.

One root restaurant holds the words of the vocabulary, and one word for all unseen ones, over a uniform base; a context
restaurant for each class of the previous word (CLASSES hash classes, so what is broadcast has a fixed size) has the root
as its parent. Tables are sampled by Gibbs sweeps over the table counts of each (context, word), given the tables of the
others, by generalised Stirling numbers; a customer of the root stands for each table of a context, and the root's own
tables are sampled the same way after each sweep. Scores use the predictive probability averaged over the last SAMPLES
sweeps; it adds up to one over the vocabulary and the unseen word.

All occurrences of a word go to one bucket, packed by numpy: a task sends one block of bytes to each bucket. Words
that hold a large share are dealt over buckets by context; their root counts, a bounded list, go through the
driver. What a sweep returns is a table over context classes. Seating is drawn from hashes of word, context and sweep, so
scores do not depend on buckets, partitions or cores; a bucket repeats the sweeps so far instead of storing their state, and
a lost executor's work comes out the same. A bucket returns sums only for the documents that have a word in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.llm import _kit as K
from meridex.session import Store

CLASSES = 1 << 16
SWEEPS = 3
SAMPLES = 2
STRENGTH = 1.0
BUCKET_BYTES = 12 << 20  # text bytes for each bucket
FLUSH = 1_500_000  # tokens that a task holds
HOT_SHARE = 0.004
HOT_PARTS = 32
HELD_MOD, HELD = 7, 2

END = int(K.mix(np.array([0xE4D], K.U), 99)[0])
_TOKENS, _WORDS, _ONCE, _TWICE = range(4)  # scalars behind the classes in a sweep's table
_HOT = 16  # then the hot words


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _open(b, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, class of the word before it, and row of each token, an end for each row included."""
    low = K.lower_ascii(raw)
    s, e, row = K.words(low, off)
    h = K.hashes(low, s, e)
    n = len(off) - 1
    before = np.concatenate([[K.U(END)], h[:-1]]).astype(K.U) if len(h) else h
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = row[1:] != row[:-1]
        before[first] = END
    tail = np.full(n, END, K.U)
    tail[row] = h  # the last word of a row stays
    w = np.concatenate([h, np.full(n, END, K.U)])
    ctx = (np.concatenate([before, tail]) & K.U(CLASSES - 1)).astype(np.uint16)
    return w, ctx, np.concatenate([row, np.arange(n)])


def _hot_of(batches):
    """Words of a share of at least HOT_SHARE among a task's sample."""
    held = []
    for b in batches:
        raw, off = K.utf8(b.column("text"))
        for i, j in K.pieces(off):
            held.append(tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])[0])
    u, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, K.U), np.zeros(0, np.int64))
    big = c >= max(2, HOT_SHARE / 4 * c.sum())
    yield pa.RecordBatch.from_arrays([pa.array(K.signed(u[big])), pa.array(c[big]), pa.array(np.full(int(big.sum()), c.sum()))], names=["w", "c", "n"])


def _is_hot(w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(w), bool)
    return hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w


def _deal(buckets: int, hot):
    """Blocks of occurrences for each bucket: part (the task's flush), words, their counts, contexts, rows; and the rows' ids and flags."""

    def run(batches):
        from pyspark import TaskContext

        task, flush = TaskContext.get().partitionId(), 0
        ws, cs, rs, ids, held, n = [], [], [], [], [], 0

        def blocks():
            w, c, r = np.concatenate(ws), np.concatenate(cs), np.concatenate(rs)
            flags = np.array(held)
            r = (r << 1 | flags[r]).astype(np.uint32)  # a document's flag stands beside its number
            g = w.copy()
            h = _is_hot(w, hot.value)
            with np.errstate(over="ignore"):
                g[h] = K.mix(w[h] + (c[h] % HOT_PARTS).astype(K.U), 3)
            to = ((g >> K.U(32)) * K.U(buckets) >> K.U(32)).astype(np.int64)
            o = np.lexsort((w, to))
            w, c, r, to = w[o], c[o], r[o], to[o]
            cut = np.searchsorted(to, np.arange(buckets + 1))
            part = (task << 20) + flush
            out = []
            for b in range(buckets):
                x = slice(cut[b], cut[b + 1])
                new = np.ones(cut[b + 1] - cut[b], bool)
                new[1:] = w[x][1:] != w[x][:-1]
                at = np.flatnonzero(new)
                if len(at):
                    out.append((b, part, len(ids), _zip(w[x][at]), _zip(np.diff(np.append(at, len(new))).astype(np.uint32)), _zip(c[x]), _zip(r[x])))
            out.append((-1 - part, part, len(ids), _zip(np.array([-1 if x is None else x for x in ids], np.int64)), _zip(np.array([x is None for x in ids])), _zip(flags), _zip(np.bincount(np.concatenate(rs), minlength=len(ids)).astype(np.uint32))))
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCK, x, strict=True)) for x in out], schema=_BLOCK_ARROW)

        for b in batches:
            raw, off = K.utf8(b.column("text"))
            for i, j in K.pieces(off):
                w, c, r = tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                ws.append(w)
                cs.append(c)
                rs.append(r + len(ids))
                ids += b.column("doc_id").slice(i, j - i).to_pylist()
                held += b.column("held").slice(i, j - i).to_pylist()
                n += len(w)
                if n > FLUSH:
                    yield blocks()
                    ws, cs, rs, ids, held, n, flush = [], [], [], [], [], 0, flush + 1
        if ids:
            yield blocks()

    return run


#: A block of a bucket; or, at bucket -1 - part, a part's documents: their ids, null ids, flags and tokens.
_BLOCK = ("bucket", "part", "n_docs", "w", "k", "ctx", "row")
_BLOCK_SQL = "bucket bigint, part bigint, n_docs int, w binary, k binary, ctx binary, row binary"
_BLOCK_ARROW = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("n_docs", pa.int32()), *[(x, pa.binary()) for x in _BLOCK[3:]]])

_MERGED = ("bucket", "part", "w", "per", "ctx", "c", "occ", "row", "parts", "sizes")
_MERGED_SQL = "bucket bigint, part bigint, w binary, per binary, ctx binary, c binary, occ binary, row binary, parts binary, sizes binary"


def _row_kind(sizes: np.ndarray):
    return np.uint32 if sizes.sum() < 2**32 else np.uint64


def _merge(table):
    """One bucket's occurrences as groups (word, context) with training counts, and the rows that they stand in; or a part's documents as they are."""
    t = table.sort_by("part").to_pydict()
    if t["bucket"][0] < 0:
        vals = (t["bucket"][0], t["part"][0], t["w"][0], t["k"][0], t["ctx"][0], t["row"][0], None, None, None, None)
        return pa.table([pa.array([v], pa.int64() if k < 2 else pa.binary()) for k, v in enumerate(vals)], names=list(_MERGED))
    sizes = np.array(t["n_docs"], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    w = np.concatenate([np.repeat(_open(a, K.U), _open(k, np.uint32)) for a, k in zip(t["w"], t["k"], strict=True)])
    ctx = np.concatenate([_open(x, np.uint16) for x in t["ctx"]])
    rows = [_open(x, np.uint32) for x in t["row"]]
    train = np.concatenate([x & 1 == 0 for x in rows])
    row = np.concatenate([(x >> 1).astype(_row_kind(sizes)) + _row_kind(sizes)(b) for x, b in zip(rows, base[:-1], strict=True)])
    o = np.lexsort((ctx, w))
    w, ctx, row, train = w[o], ctx[o], row[o], train[o]
    neww = np.ones(len(w), bool)
    neww[1:] = w[1:] != w[:-1]
    new = neww.copy()
    new[1:] |= ctx[1:] != ctx[:-1]
    at = np.flatnonzero(new)
    cum = np.concatenate([[0], np.cumsum(train)])
    occ = np.diff(np.append(at, len(w)))
    c = cum[at + occ] - cum[at]
    aw = np.flatnonzero(neww[at])
    per = np.diff(np.append(aw, len(at)))
    vals = (t["bucket"][0], None, _zip(w[at][aw]), _zip(per.astype(np.uint32)), _zip(ctx[at]), _zip(c.astype(np.uint32)), _zip(occ.astype(np.uint32)), _zip(row), _zip(np.array(t["part"], np.int64)), _zip(sizes))
    return pa.table([pa.array([v], pa.int64() if k < 2 else pa.binary()) for k, v in enumerate(vals)], names=list(_MERGED))


def log_stirling(most: int, d: float) -> np.ndarray:
    """log S(c, t) for 1 <= t <= c <= most: seatings of c customers at t tables, up to factors of the strength."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, 0 : c + 1], s[c, 1 : c + 2] + np.log(np.maximum(c - t * d, 1e-300)))
    return s


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and salt alone."""
    return ((K.mix(seed, salt) >> K.U(11)).astype(float) + 0.5) / 2**53


def _binomial(m: np.ndarray, p: np.ndarray, seed: np.ndarray, salt: int) -> np.ndarray:
    """Successes among m: one by one for few, else by the normal approximation."""
    out = np.zeros(len(m), np.int64)
    few = np.flatnonzero(m < 32)
    for j in range(int(m[few].max(initial=0))):
        out[few] += (j < m[few]) & (_uniform(seed[few], salt + 7919 * j + 1) < p[few])
    many = np.flatnonzero(m >= 32)
    if len(many):
        z = np.sqrt(-2 * np.log(_uniform(seed[many], salt))) * np.cos(2 * np.pi * _uniform(seed[many], salt + 104729))
        mean = m[many] * p[many]
        out[many] = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - p[many]))), 0, m[many]).astype(np.int64)
    return out


def seat(c: np.ndarray, a: np.ndarray, d: float, seed: np.ndarray, salt: int = 0, exact: int = 24) -> np.ndarray:
    """Table counts for c customers of one dish; a: weight of a new table, (strength + discount * tables) * parent's probability.

    Up to `exact` customers they are drawn from their conditional distribution; the rest arrive in growing groups. Each dish
    draws by its own seed.
    """
    t = np.minimum(c, 1).astype(np.int64)
    s = log_stirling(exact, d)
    for k in range(2, exact + 1):
        at = np.flatnonzero(c == k) if k < exact else np.flatnonzero(c >= k)
        for i in range(0, len(at), 1 << 16):
            z = at[i : i + (1 << 16)]
            lp = s[k, 1 : k + 1][None] + np.log(a[z])[:, None] * np.arange(1, k + 1)
            p = np.exp(lp - lp.max(1, keepdims=True))
            cum = np.cumsum(p, 1)
            t[z] = 1 + (_uniform(seed[z], salt)[:, None] * cum[:, -1:] > cum[:, :-1]).sum(1)
    at, n, step = np.flatnonzero(c > exact), float(exact), 1
    while len(at):
        m = np.minimum(c[at] - n, max(1.0, n // 8)).astype(np.int64)
        t[at] += _binomial(m, np.clip(a[at] / (n - d * t[at] + a[at]), 0, 1), seed[at], salt + 15485863 * step)
        n += max(1.0, n // 8)
        step += 1
        at = at[c[at] > n]
    return np.minimum(t, np.maximum(c, 0))


def root_tables(customers: np.ndarray, w: np.ndarray, k: int, before: dict | None) -> np.ndarray:
    """The root's tables of words w after sweep k; before: what the sweep before has left. At first each word has one."""
    if before is None:
        return np.minimum(customers, 1)
    a = (STRENGTH + before["d0"] * before["T0"]) / (before["V"] + 1)
    return seat(customers, np.full(len(w), a), before["d0"], w, 1_000_003 * k)


def root_probability(customers: np.ndarray, tables: np.ndarray, g: dict) -> np.ndarray:
    """The root's probability of words; no customers and no tables: that of the unseen word."""
    return (customers - g["d0"] * tables + (STRENGTH + g["d0"] * g["T0"]) / (g["V"] + 1)) / (STRENGTH + g["C0"])


def _restaurants(r: dict, history: list[dict], hot: np.ndarray):
    """After each sweep so far, as many as history has: tables of groups, and root customers and root tables of words."""
    w, per, ctx, c = _open(r["w"], K.U), _open(r["per"], np.uint32).astype(np.int64), _open(r["ctx"], np.uint16), _open(r["c"], np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(w)), per)
    is_hot = _is_hot(w, hot)
    where = np.searchsorted(hot, w[is_hot])
    seed = K.mix(w[word] ^ K.mix(ctx.astype(K.U), 5), 6)
    t, out = np.minimum(c, 1), []
    for k in range(len(history) + 1):
        if k:
            g = history[k - 1]
            root, t0 = out[-1][1].copy(), out[-1][2].copy()
            root[is_hot], t0[is_hot] = g["hot_t"][where], g["hot_t0"][where]  # over all buckets
            a = (STRENGTH + g["d1"] * g["t"][ctx]) * root_probability(root, t0, g)[word]
            t = seat(c, np.maximum(a, 1e-300), g["d1"], seed, k)
        root = np.bincount(word, weights=t, minlength=len(w)).astype(np.int64)
        out.append((t, root, root_tables(root, w, k, history[k - 1] if k else None)))
    return w, word, ctx, c, is_hot, where, out


def sums(r: dict, history: list[dict], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more sweep over a bucket: sums by class (customers, tables), scalars and hot words."""
    a, b = np.zeros((2, CLASSES + _HOT + len(hot)), np.int64)
    w, word, ctx, c, is_hot, where, states = _restaurants(r, history, hot)
    t, root, t0 = states[-1]
    a[:CLASSES] += np.bincount(ctx, weights=c, minlength=CLASSES).astype(np.int64)
    b[:CLASSES] += np.bincount(ctx, weights=t, minlength=CLASSES).astype(np.int64)
    cw = np.bincount(word, weights=c, minlength=len(w)).astype(np.int64)
    a[CLASSES + _TOKENS] = c.sum()
    b[CLASSES + _TOKENS] = t0[~is_hot].sum()
    a[CLASSES + _WORDS] = (cw[~is_hot] > 0).sum()
    for k, (x, z) in {_ONCE: (c == 1, root[~is_hot] == 1), _TWICE: (c == 2, root[~is_hot] == 2)}.items():
        a[CLASSES + k], b[CLASSES + k] = x.sum(), z.sum()
    np.add.at(a, CLASSES + _HOT + where, cw[is_hot])
    np.add.at(b, CLASSES + _HOT + where, root[is_hot])
    return a, b


def _sweep(history, hot):
    def run(batches):
        a, b = np.zeros((2, CLASSES + _HOT + len(hot.value)), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                x, y = sums(r, history.value, hot.value)
                a += x
                b += y
        at = np.flatnonzero((a > 0) | (b > 0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(a[at]), pa.array(b[at])], names=["k", "a", "b"])

    return run


def collected(a: np.ndarray, b: np.ndarray, hot: np.ndarray, history: list[dict]) -> dict:
    """What a sweep has left, from its sums over all buckets."""
    s = lambda k, x=a: int(x[CLASSES + k])
    hc, ht = a[CLASSES + _HOT :], b[CLASSES + _HOT :]
    share = lambda one, two: float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5
    hot_t0 = root_tables(ht, hot, len(history), history[-1] if history else None)
    return {"c": a[:CLASSES].astype(float), "t": b[:CLASSES].astype(float), "N": s(_TOKENS), "V": s(_WORDS) + int((hc > 0).sum()), "C0": int(b[:CLASSES].sum()),
            "T0": s(_TOKENS, b) + int(hot_t0.sum()), "d1": share(s(_ONCE), s(_TWICE)), "d0": share(s(_ONCE, b), s(_TWICE, b)), "hot_c": hc, "hot_t": ht, "hot_t0": hot_t0}


def _globals(found: DataFrame, hot: np.ndarray, history: list[dict]) -> dict:
    """A sweep's sums: a row per context class, a few scalars, and the hot words."""
    rows = found.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    a, b = np.zeros((2, CLASSES + _HOT + len(hot)), np.int64)
    a[rows["k"]], b[rows["k"]] = rows["a"], rows["b"]
    return collected(a, b, hot, history)


def predictive(r: dict, hist: list[dict], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group of a bucket: its probability in its context, averaged; its word's training count; and the root's probability of its word."""
    w, word, ctx, c, is_hot, where, states = _restaurants(r, hist[:-1], hot)
    p, p0s = np.zeros(len(c)), np.zeros(len(c))
    for k in range(len(hist) - SAMPLES, len(hist)):
        g, (t, root, t0) = hist[k], states[k]
        root, t0 = root.copy(), t0.copy()
        root[is_hot], t0[is_hot] = g["hot_t"][where], g["hot_t0"][where]
        p0 = root_probability(root, t0, g)[word]
        d1 = hist[k - 1]["d1"]
        p += (c - d1 * t + (STRENGTH + d1 * g["t"][ctx]) * p0) / (STRENGTH + g["c"][ctx]) / SAMPLES
        p0s += p0 / SAMPLES
    cw = np.bincount(word, weights=c, minlength=len(w)).astype(np.int64)
    cw[is_hot] = hist[-1]["hot_c"][where]
    return p, cw[word], p0s


def _score(history, hot):
    """For each part that has a word in the bucket: the rows that have one, and sums over them of log10 p, log10 (c + 1) and known tokens, packed."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                p, cw, _ = predictive(r, history.value, hot.value)
                occ, sizes, parts = _open(r["occ"], np.uint32), _open(r["sizes"], np.int64), _open(r["parts"], np.int64)
                rows, place = np.unique(_open(r["row"], _row_kind(sizes)), return_inverse=True)
                lp, lc, known = (np.bincount(place, weights=np.repeat(x, occ), minlength=len(rows)) for x in (np.log10(p), np.log10(cw + 1), (cw > 0).astype(float)))
                start = np.concatenate([[0], np.cumsum(sizes)])
                cut = np.searchsorted(rows, start.astype(rows.dtype))
                packed = [[_zip(x[cut[i] : cut[i + 1]].astype(kind)) for i in range(len(parts))] for x, kind in ((lp, float), (lc, float), (known, np.uint32))]
                local = [_zip((rows[cut[i] : cut[i + 1]] - rows.dtype.type(start[i])).astype(np.uint32)) for i in range(len(parts))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), r["bucket"])), pa.array(parts), *[pa.array(x, pa.binary()) for x in (local, *packed)]], names=["b", "part", "row", "lp", "lc", "known"])

    return run


def _gather(total: int, words: int):
    def run(left, right):
        """left: a part's documents; right: its sums from the buckets, added in the buckets' order."""
        ids = left.to_pydict()
        doc, null, held, n = _open(ids["w"][0], np.int64), _open(ids["per"][0], bool), _open(ids["ctx"][0], bool), _open(ids["c"][0], np.uint32).astype(np.int64)
        got = right.to_pydict()
        lp, lc, known = np.zeros((3, len(doc)))
        for i in np.argsort(got["b"]):
            at = _open(got["row"][i], np.uint32)
            for x, name, kind in ((lp, "lp", float), (lc, "lc", float), (known, "known", np.uint32)):
                x[at] += _open(got[name][i], kind)
        return pa.table(
            [pa.array(doc, mask=null), pa.array(held), pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(doc), total, np.int64)), pa.array(lc - n * np.log10(total + words + 1)), pa.array(lp)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, store: Store) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Null and empty texts are their end alone. A null doc_id counts as '' for the hold-out and stays null.
    Repeated rows are each learned from and each get a row. Without training rows, every probability is that
    of the base. More columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_MOD == HELD).alias("held"))
    size, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-size // BUCKET_BYTES), min(sc.defaultParallelism, size // (1 << 20)))
    # How blocks are dealt, and nothing else, depends on this sample: hot words draw by the same seeds.
    some = rows.sample(False, min(1.0, 2000 / max(1, n)), 11).select("text").mapInArrow(_hot_of, "w bigint, c bigint, n bigint")
    seen = some.groupBy("w").agg(F.sum("c").alias("c")).orderBy(F.desc("c")).limit(int(4 / HOT_SHARE)).collect()
    total = sum(r.c for r in seen) or 1
    hot = np.sort(np.array([r.w for r in seen if r.c >= HOT_SHARE * total], np.int64).view(K.U))
    sent = sc.broadcast(hot)
    merged = store.save(rows.mapInArrow(_deal(buckets, sent), _BLOCK_SQL).groupBy("bucket").applyInArrow(_merge, _MERGED_SQL), "buckets")
    ids, merged = merged.where("bucket < 0").select("part", "w", "per", "ctx", "c"), merged.where("bucket >= 0").drop("part")
    history: list[dict] = []
    groups = merged.select("bucket", "w", "per", "ctx", "c")
    for _ in range(SWEEPS + 1):
        history.append(_globals(groups.mapInArrow(_sweep(sc.broadcast(history), sent), "k bigint, a bigint, b bigint"), hot, history))
    g = history[0]
    scored = merged.mapInArrow(_score(sc.broadcast(history), sent), "b bigint, part bigint, row binary, lp binary, lc binary, known binary")
    return ids.groupBy("part").cogroup(scored.groupBy("part")).applyInArrow(
        _gather(g["N"], g["V"]), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
