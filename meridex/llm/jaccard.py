"""Size-aware heavy-light Jaccard join over word shingles.

Documents become sets of hashed 5-word shingles; equal sets form one class, and only classes
are joined. Two classes can reach the threshold only when they share

* one of their fixed-size subsets, for small sets (`subset keys`), or
* SHARED of the first n - ceil(t * n) + SHARED shingles in a common order, for large sets (`prefix keys`).

The order puts frequent ("heavy") shingles last, so passages that many documents share seldom
become keys. The boundary between small and large minimises the estimated cost: subsets to
enumerate against list entries to scan. Sets up to 1/t times the boundary post both kinds of key.

A set posts its heavy prefix keys only when it has SHARED of them or more: any other pair must share
a light key. Two sets that both do meet by a heavy key only where their heavy shingles alone could reach the overlap
they need; any others must share a light shingle, and all of these are keys of both. With c common prefix keys, two sets have at most c + max(n - p, m - q) common shingles, p and q
being the prefix lengths; pairs that cannot reach the overlap they need are dropped before any set is read. So are those whose odd
sketches rule them out: a sketch has the parities of a set's hashes over as many bins as suit its size, and two sets differ in a shingle
at least for each bin in which their parities do. Of most pairs that share a passage only these bits travel, never the sets.

Lists are scanned in a shuffle by key; the list of a heavy key is dealt over several tasks. A first
round verifies for each class its most promising neighbour, hub rounds let a few classes of each list meet the others of
it as long as that joins many. Later, only pairs that are not yet in one
component are verified, so thousands of near copies never become all their pairs, while no link that
would join two components is lost.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.llm import _kit as K
from meridex.operators.graph import connected_components
from meridex.operators.order import running
from meridex.session import Store

#: Heavy shingles kept for the order (any order is exact; this bounds the broadcast to 16 MB).
HEAVY_MOST = 1 << 20
HEAVY_LEAST = 16
#: Entries of one key's list that one task scans.
LIST_TASK = 2048
SMALL_MOST = 14
#: Prefix keys that two large sets must share to become a candidate pair (fewer for tiny sets).
SHARED = 4
#: Bins of an odd sketch for each two shingles, at least, and those of the smallest one. Their number is a power of two.
ODD_BINS, ODD_LEAST = 3, 64
#: Hub rounds end at so many, or with so few pairs left for each entry, or with fewer links than an entry in so many.
HUB_ROUNDS = 12
HUB_LEAST = 1
HUB_FRUIT = 500


def ceil_share(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, sorted by row, then hash."""
    low = K.lower_ascii(raw)
    s, e, row = K.words(low, off)
    h = K.hashes(low, s, e)
    with np.errstate(over="ignore"):
        rows, vals = [], []
        if len(h) >= width:
            acc = np.zeros(len(h) - width + 1, K.U)
            for j in range(width):
                acc = acc * K.U(0xC2B2AE3D27D4EB4F) + h[j : len(h) - width + 1 + j]
            ok = row[: len(acc)] == row[width - 1 :]
            rows.append(row[: len(acc)][ok])
            vals.append(K.mix(acc[ok], width))
        n = np.bincount(row, minlength=len(off) - 1) if len(row) else np.zeros(len(off) - 1, np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        for k in range(1, width):  # shorter texts: the whole sequence is the one shingle
            short = np.flatnonzero(n == k)
            if len(short):
                acc = np.zeros(len(short), K.U)
                for j in range(k):
                    acc = acc * K.U(0xC2B2AE3D27D4EB4F) + h[first[short] + j]
                rows.append(short)
                vals.append(K.mix(acc, k))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, K.U)
    r, v = np.concatenate(rows), np.concatenate(vals)
    o = np.lexsort((v, r))
    r, v = r[o], v[o]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[keep], v[keep]


def _rows(batch: pa.RecordBatch, name: str):
    raw, off = K.utf8(batch.column(name))
    for i, j in K.pieces(off):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]


def _survey(width: int):
    """Per task: (0, shingle, count) for shingles in two or more of its documents, (1, set size, documents), (2, 0, shingles)."""

    def run(batches):
        held, size, hist, total = [], 0, np.zeros(64, np.int64), 0
        keep_v, keep_c = np.zeros(0, K.U), np.zeros(0, np.int64)

        def fold(last: bool):
            nonlocal held, size, keep_v, keep_c
            v = np.concatenate([*held, keep_v])
            c = np.concatenate([np.ones(len(v) - len(keep_v), np.int64), keep_c])
            u, inv = np.unique(v, return_inverse=True)
            n = np.bincount(inv, weights=c).astype(np.int64) if len(u) else np.zeros(0, np.int64)
            big = n >= 2
            keep_v, keep_c, held, size = u[big], n[big], [], 0

        for b in batches:
            for i, j, raw, off in _rows(b, "text"):
                r, v = shingle_sets(raw, off, width)
                held.append(v)
                size += len(v)
                total += len(v)
                n = np.bincount(r, minlength=j - i)
                hist += np.bincount(n[n < 64], minlength=64)
                if size > 1 << 22:
                    fold(False)
        fold(True)
        nz = np.flatnonzero(hist)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(keep_v), np.int32), np.ones(len(nz), np.int32), [2]]).astype(np.int32)),
                pa.array(np.concatenate([K.signed(keep_v), nz, [0]]).astype(np.int64)),
                pa.array(np.concatenate([keep_c, hist[nz], [total]]).astype(np.int64)),
            ],
            names=["kind", "v", "c"],
        )

    return run


def choose_boundary(hist: dict[int, int], mean_list: float, num: int, den: int) -> int:
    """The largest size whose sets are joined by subsets, at the least estimated cost.

    It may pass SMALL_MOST, so that sets of that size need not post prefix keys as well.
    """
    most = SMALL_MOST * den // num
    subsets = lambda n: sum(math.comb(n, k) for k in range(ceil_share(n, num, den), n + 1))
    scan = lambda n: (n - ceil_share(n, num, den) + min(SHARED, ceil_share(n, num, den))) * (1 + mean_list)
    costs = [
        sum(c * subsets(n) for n, c in hist.items() if 0 < n <= b) + sum(c * scan(n) for n, c in hist.items() if ceil_share(b + 1, num, den) <= n <= most)
        for b in range(most + 1)
    ]
    return int(np.argmin(costs))


def _subset_keys(v: np.ndarray, num: int, den: int) -> np.ndarray:
    n, out = len(v), []
    for k in range(ceil_share(n, num, den), n + 1):
        idx = np.array(list(combinations(range(n), k)), np.int64)
        acc = np.full(len(idx), k + 1, K.U)
        with np.errstate(over="ignore"):
            for j in range(k):
                acc = acc * K.U(0x9FB21C651E98DF25) + v[idx[:, j]]
        out.append(K.mix(acc, 77))
    return np.concatenate(out)


def signatures(v: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set; n: the sizes of the sets that stand in v one after another."""
    at, out = np.concatenate([[0], np.cumsum(n)]), []
    with np.errstate(over="ignore"):
        for salt in (1, 2):
            cum = np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(v, salt))])
            out.append(K.mix((cum[at[1:]] - cum[at[:-1]]) ^ n.astype(K.U), salt))
    return out


def odd_sketches(v: np.ndarray, n: np.ndarray) -> pa.Array:
    """The odd sketch of each set: the parity of its hashes in each bin, a bin being their low bits."""
    bins = np.array([max(ODD_LEAST, 1 << max(0, int(x) * ODD_BINS // 2 - 1).bit_length()) for x in n.tolist()], np.int64)
    at = np.cumsum(bins) - bins
    row = np.repeat(np.arange(len(n)), n)
    odd = np.bincount(at[row] + (v & (bins[row] - 1).astype(K.U)).astype(np.int64), minlength=int(bins.sum())) & 1
    return K.binary_column(np.packbits(odd.astype(np.uint8), bitorder="little"), bins // 8)


def _may_link(num: int, den: int):
    """Keeps the pairs that their odd sketches do not rule out."""

    def run(batches):
        for b in batches:
            keep = np.zeros(len(b), bool)
            sizes = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
            for i, (x, y) in enumerate(zip(b.column("odd_a"), b.column("odd_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), K.U), np.frombuffer(y.as_buffer(), K.U)
                m = min(len(x), len(y))  # the halves of the longer one add up to a sketch of half as many bins
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, m), axis=0) for z in (x, y))
                keep[i] = int(np.bitwise_count(x ^ y).sum()) * (num + den) <= int(sizes[i]) * (den - num)
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(m), b.column("b").filter(m)], names=["a", "b"])

    return run


def _describe(width: int, num: int, den: int, boundary: int, heavy_v, heavy_c):
    """Per document: set size, 128-bit set signature, keys (prefix keys first), how many are prefix keys, and odd sketch.

    Of a task's equal sets only the first has keys and sketch.
    """

    def run(batches):
        hv, hc = heavy_v.value, heavy_c.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            ids = b.column("doc_id")
            for i, j, raw, off in _rows(b, "text"):
                r, v = shingle_sets(raw, off, width)
                m = j - i
                n = np.bincount(r, minlength=m)
                sig = signatures(v, n)
                new = []
                for d, two in enumerate(zip(sig[0].tolist(), sig[1].tolist(), strict=True)):
                    if n[d] and two not in seen and ids[i + d].is_valid:
                        seen.add(two)
                        new.append(d)
                one = np.zeros(m, bool)
                one[new] = True
                all_n, mine = n, one[r]
                r, v, n = r[mine], v[mine], np.where(one, n, 0)
                at = np.concatenate([[0], np.cumsum(n)])
                cnt = np.zeros(len(v), np.int64)
                if len(hv) and len(v):
                    k = np.minimum(np.searchsorted(hv, v), len(hv) - 1)
                    cnt = np.where(hv[k] == v, hc[k], 0)
                o = np.lexsort((v, cnt, r))
                r2, v2 = r[o], v[o]
                pos = np.arange(len(v)) - at[r2]
                must = (n * num + den - 1) // den
                need = n - must + np.minimum(SHARED, must)
                take = (pos < need[r2]) & (n[r2] >= (ceil_share(boundary + 1, num, den)))
                keys, pre = v2[take], np.bincount(r2[take], minlength=m)
                total = pre.copy()
                small = np.flatnonzero((n > 0) & (n <= boundary))
                if len(small):
                    parts, last = [], 0
                    pat = np.concatenate([[0], np.cumsum(pre)])
                    for d in small:
                        parts += [keys[last : pat[d + 1]], sub := _subset_keys(v[at[d] : at[d + 1]], num, den)]
                        last, total[d] = pat[d + 1], total[d] + len(sub)
                    keys = np.concatenate([*parts, keys[last:]])
                none = pa.scalar(None, pa.binary())
                keys, odd = (pc.if_else(pa.array(one), x, none) for x in (K.binary_column(keys, total), odd_sketches(v, n)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, m), pa.array(all_n.astype(np.int64)), pa.array(K.signed(sig[0])), pa.array(K.signed(sig[1])), keys, pa.array(pre.astype(np.int32)), odd],
                    names=["doc_id", "n_shingles", "s1", "s2", "keys", "n_prefix", "odd"],
                )

    return run


def _post(heavy_v, heavy_c):
    """A row for each key of each class; salt deals a heavy key's list over tasks: 0 for a whole list, from 1 on for one in parts."""

    def run(batches):
        hv, hc = heavy_v.value, heavy_c.value
        for b in batches:
            rep, n, pre = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n_shingles", "n_prefix"))
            keys = b.column("keys")
            offs = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
            v = np.frombuffer(keys.buffers()[2], K.U, count=offs[-1] // 8)[offs[0] // 8 :] if offs[-1] else np.zeros(0, K.U)
            c = np.diff(offs) // 8
            row = np.repeat(np.arange(len(rep)), c)
            pos = np.arange(len(v)) - np.repeat(np.concatenate([[0], np.cumsum(c)[:-1]]), c)
            pos = np.where(pos < pre[row], pos, -1)
            salt = np.zeros(len(v), np.int64)
            if len(hv) and len(v):
                k = np.minimum(np.searchsorted(hv, v), len(hv) - 1)
                parts = np.where(hv[k] == v, hc[k], 0) // LIST_TASK + 1
                salt = np.where(parts > 1, 1 + (K.mix(rep[row].view(K.U), 5) % parts.astype(K.U)).astype(np.int64), 0)
                heavy = (hv[k] == v) & (pos >= 0)
            else:
                heavy = np.zeros(len(v), bool)
            h = np.bincount(row[heavy], minlength=len(rep))
            keep = ~heavy | (h[row] >= SHARED)
            v, row, pos, salt = v[keep], row[keep], pos[keep], salt[keep]
            for a in range(0, len(v), 1 << 18):
                z = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(K.signed(v[z])), pa.array(salt[z].astype(np.int32)), pa.array(rep[row[z]]), pa.array(n[row[z]].astype(np.int32)), pa.array(pos[z].astype(np.int32)), pa.array(h[row[z]].astype(np.int32))],
                    names=["key", "salt", "id", "n", "pos", "h"],
                )

    return run


def _scan_lists(num: int, den: int):
    """Runs of equal (key, salt), sorted by size: entries of lists with two or more, each with two earlier
    entries that it may link with (the first of a fitting size, and the one before it).

    A salted list keeps single entries too, as their partners may be in another part.
    """

    def run(batches):
        tail = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if tail is not None:
                t = pa.concat_tables([tail, t]).combine_chunks()
            key, salt = t["key"].to_numpy(), t["salt"].to_numpy()
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
            cut = last[-1] + 1 if len(last) else 0
            tail = t.slice(cut)
            if cut:
                yield from _runs(t.slice(0, cut), num, den)
        if tail is not None and len(tail):
            yield from _runs(tail, num, den)

    return run


def _runs(t: pa.Table, num: int, den: int):
    key, salt, ids, n, pos, h = (t[c].to_numpy() for c in ("key", "salt", "id", "n", "pos", "h"))
    again = np.append(False, (key[1:] == key[:-1]) & (ids[1:] == ids[:-1]))[: len(key)]  # a set that several tasks posted
    if again.any():
        key, salt, ids, n, pos, h = (x[~again] for x in (key, salt, ids, n, pos, h))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    keep = np.repeat((size > 1) | (salt[start] > 0), size)
    if not keep.any():
        return
    at = np.repeat(start, size)
    here = np.arange(len(key))
    # first entry of the run whose size is at least the share of this one's (n is sorted in the run)
    rank = n.astype(np.int64) + np.cumsum(new) * (1 << 32)
    least = (n.astype(np.int64) * num + den - 1) // den + np.cumsum(new) * (1 << 32)
    hub = np.searchsorted(rank, least)
    prev = np.maximum(here - 1, at)
    prev = np.where(rank[prev] >= least, prev, hub)
    hub, prev = (np.where(x < here, ids[x], np.int64(-(2**63))) for x in (hub, prev))
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, ids, n, pos, h, hub, prev)], names=["key", "id", "n", "pos", "h", "hub", "prev"])


def _sets(width: int):
    def run(batches):
        for b in batches:
            for i, j, raw, off in _rows(b, "text"):
                r, v = shingle_sets(raw, off, width)
                n = np.bincount(r, minlength=j - i)
                s1, s2 = signatures(v, n)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(s1)), pa.array(K.signed(s2)), K.binary_column(v, n)], names=["id", "s2", "set"])

    return run


def _verify(num: int, den: int):
    """Keeps the pairs that reach the threshold, counted exactly over their whole sets."""

    def run(batches):
        for b in batches:
            a, c, x, y = (b.column(k) for k in ("a", "b", "set_a", "set_b"))
            ok = np.zeros(len(a), bool)
            was, u = None, None
            for i in range(len(a)):
                if was != a[i].as_py():
                    was, u = a[i].as_py(), np.frombuffer(x[i].as_buffer(), K.U)
                v = np.frombuffer(y[i].as_buffer(), K.U)
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = den * inter >= num * (len(u) + len(v) - inter)
            m = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(m), c.filter(m)], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, store: Store, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Classes of documents linked by shingle Jaccard >= num / den.

    docs: doc_id bigint, text string; more columns are ignored. Returns a row per input row:
    doc_id, n_shingles, component_id (the least doc_id that links reach). Null, empty and wordless
    texts have no shingles and link with nothing; so has a null doc_id, whose component_id is null.
    Repeated rows each return a row. Rows that share a doc_id but differ in text are each linked by
    their own text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = docs.select("text")
    seen = store.save(texts.mapInArrow(_survey(width), "kind int, v bigint, c bigint"), "survey")
    rows = seen.where("kind > 0").groupBy("kind", "v").agg(F.sum("c").alias("c")).collect()  # at most 65 rows
    hist = {r.v: r.c for r in rows if r.kind == 1}
    total = max(1, sum(r.c for r in rows if r.kind == 2))
    top = (seen.where("kind = 0").groupBy("v").agg(F.sum("c").alias("c")).where(f"c >= {HEAVY_LEAST}")
           .orderBy(F.desc("c"), "v").limit(HEAVY_MOST).toPandas())
    top = top.sort_values("v", key=lambda s: s.astype("int64").to_numpy().view(np.uint64))
    hv, hc = top["v"].to_numpy(np.int64).view(K.U), top["c"].to_numpy(np.int64)
    store.drop(seen)
    mean_list = 1 + float((hc.astype(float) ** 2).sum()) / total
    boundary = choose_boundary(hist, mean_list, num, den)
    bv, bc = spark.sparkContext.broadcast(hv), spark.sparkContext.broadcast(hc)

    base = store.save(docs.mapInArrow(_describe(width, num, den, boundary, bv, bc), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, keys binary, n_prefix int, odd binary"), "base")
    # A class goes by the first half of its signature; of the vanishingly few classes that share it, the others stand alone.
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = store.save(classes, "classes")
    owner = classes.groupBy(F.col("s1").alias("id")).agg(F.min(F.struct("s2", "rep")).alias("o")).select("id", "o.s2", "o.rep")
    posted = (base.where("keys is not null").select(F.col("s1").alias("id"), "n_shingles", "keys", "n_prefix")
              .mapInArrow(_post(bv, bc), "key bigint, salt int, id bigint, n int, pos int, h int"))
    lists = store.save(
        posted.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "id")
        .mapInArrow(_scan_lists(num, den), "key bigint, id bigint, n int, pos int, h int, hub bigint, prev bigint"), "lists",
    )
    odds = base.where("odd is not null").select(F.col("s1").alias("id"), F.col("n_shingles").cast("int").alias("n"), "s2", "odd")
    odds = odds.join(lists.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("n", "odd"), "s2").alias("o"))
    odds = store.save(odds.select("id", "o.n", "o.odd"), "odds")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that reach the threshold; only the texts of documents in pairs that may reach it are fetched."""
        pairs = store.save(pairs, name)
        both = (pairs.join(odds.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("odd_a")), "a")
                .join(odds.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("odd_b")), "b"))
        some = store.save(both.select("a", "b", "na", "nb", "odd_a", "odd_b").mapInArrow(_may_link(num, den), "a bigint, b bigint"), "some")
        wanted = store.save(some.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(owner, "id"), "wanted")
        sets = docs.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(width), "id bigint, s2 bigint, set binary")
        sets = sets.join(wanted.select("id", "s2"), ["id", "s2"], "left_semi")
        sets = store.save(sets.groupBy("id").agg(F.min("set").alias("set")), "sets")
        left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
        right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        both = some.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")
        out = store.save(both.mapInArrow(_verify(num, den), "a bigint, b bigint"), "edges")
        store.drop(pairs, some, wanted, sets)
        return out

    # Round 1: each class with the earlier class that it meets in most lists.
    met = (lists.select("id", F.when(F.col("pos") < 0, SHARED).otherwise(1).alias("w"), F.explode(F.array_distinct(F.array("hub", "prev"))).alias("to"))
           .where(f"`to` > {-(2**63) + 1}L and `to` <> id").groupBy("id", "to").agg(F.sum("w").alias("c")).where("c >= 2"))
    first = met.groupBy("id").agg(F.max(F.struct("c", "to")).alias("m")).select(F.col("m.to").alias("a"), F.col("id").alias("b"))
    edges = linked(first, "pairs1")
    part = store.save(connected_components(edges, store), "part1")

    # all: the heavy shingles of a whole set that posts heavy keys; the heavy ones of its keys stand last.
    must = lambda n: f"(({n} * {num} + {den - 1}) div {den})"
    tail = lambda n: f"({must(n)} - least({SHARED}, {must(n)}))"  # noqa: E731  shingles behind the prefix
    fits = (F.expr(f"{num} * greatest(x.n, y.n) <= {den} * least(x.n, y.n)")
            & F.expr(f"x.pos < 0 or y.pos < 0 or {num + den} * (1 + least(x.pos, y.pos) + least(x.n - x.pos - 1, y.n - y.pos - 1)) >= {num} * (x.n + y.n)")
            & F.expr(f"not x.heavy or {num} * (x.n + y.n) <= {num + den} * least(x.all, y.all)"))
    weight = F.when(F.expr("x.pos < 0 or y.pos < 0"), 1 << 20).otherwise(1).alias("w")

    def unjoined(entries: DataFrame, part: DataFrame) -> DataFrame:
        """Entries of the lists that hold more than one component, where they may link with another entry."""
        at = entries.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
        many = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least_n")).where("lo <> hi").select("key", "least_n")
        at = at.join(many, "key").where(f"not heavy or {num} * (n + least_n) <= {num + den} * all")
        return store.save(at.select("key", "id", "n", "pos", "h", "all", "heavy", "c"), "apart")

    entries = lists.select("key", "id", "n", "pos", "h").withColumn("all", F.expr(f"h + {tail('n')}")).withColumn("heavy", F.expr("pos >= n - all"))
    at = unjoined(entries, part)
    links = edges
    # Hub rounds: two classes of each list, the same in many lists, meet the list's other components. They only save
    # work, growing with the entries; what they leave apart is joined in full below.
    for k in range(HUB_ROUNDS):
        sizes = at.groupBy("key", "c").agg(F.count("*").cast("double").alias("m")).groupBy("key").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
        left = sizes.agg(F.sum("s").alias("entries"), (F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")).first()
        if not left.entries or left.pairs <= HUB_LEAST * left.entries:
            break
        rare = F.expr("n - all") if k == 0 else F.lit(0)  # a class with few rare shingles stands amid its near copies
        hub = F.struct(rare.alias("rare"), F.xxhash64("id", F.lit(k)).alias("r"), "key", "id", "n", "pos", "all", "c")
        hubs = at.groupBy("key").agg(F.array(F.min(hub), F.max(hub)).alias("hubs")).select(F.explode("hubs").alias("y")).select("y.*")
        met = (at.alias("x").join(hubs.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & fits)
               .select(F.col("x.id").alias("b"), F.col("y.id").alias("a"), weight).groupBy("a", "b").agg(F.sum("w").alias("w")))
        new = linked(met.groupBy("b").agg(F.max(F.struct("w", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "hubs")
        found = new.count()
        if found:
            links = links.unionByName(new)
            part = connected_components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new), store)
            at, was = unjoined(at.drop("c"), part), at
            store.drop(was)
        if found * HUB_FRUIT < left.entries:
            break

    # The rest: pairs of one list that are not yet in one component.
    x, y = at.alias("x"), at.alias("y")
    common = f"(((nx + ny) * {num} + {num + den - 1}) div {num + den})"  # shingles that the two must share
    unseen = f"case when hx < {SHARED} and hy < {SHARED} then least(hx, hy) when hx < {SHARED} then hx when hy < {SHARED} then hy else 0 end"
    rest = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")) & fits)
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny"),
                    F.col("x.h").alias("hx"), F.col("y.h").alias("hy"), F.least("x.all", "y.all").alias("all"), weight)
            .groupBy("a", "b", "nx", "ny", "hx", "hy", "all").agg(F.sum("w").alias("w"))
            .where(f"case when least(hx, hy) >= {SHARED} and all < {common} then w + all >= {common} "
                   f"else w + {unseen} >= {common} - greatest({tail('nx')}, {tail('ny')}) end").select("a", "b"))
    more = linked(rest, "pairs2")
    part2 = connected_components(links.unionByName(more), store)
    part2 = part2.withColumnRenamed("node", "id").join(owner, "id")
    least = part2.groupBy("component").agg(F.min("rep").alias("least"))
    placed = part2.join(least, "component").select(F.col("id").alias("s1"), "s2", "least")
    classes = classes.join(placed, ["s1", "s2"], "left").select("s1", "s2", F.col("n_shingles").alias("n"), F.coalesce("least", "rep").alias("component"))
    classes = store.save(classes, "components")
    store.drop(lists, odds, part, at, edges, more)
    b = base.select("doc_id", "n_shingles", "s1", "s2")
    none = b.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    some = (b.where("n_shingles > 0 and doc_id is not null").alias("b")
            .join(classes.alias("c"), F.expr("b.s1 = c.s1 and b.s2 = c.s2 and b.n_shingles = c.n"))
            .select("b.doc_id", "b.n_shingles", F.col("c.component").alias("component_id")))
    return some.unionByName(none)


def keep_one(docs: DataFrame, store: Store) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id; the rest of the columns stay.

    Rows that share a doc_id but differ in text are documents of their own: each is linked by its own text, and stays or goes by
    itself. Documents without words, and rows without a doc_id, are kept. Repeated rows (doc_id and text) stay one row. An empty table gives an
    empty result.
    """
    d = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2"))
    own = d.where("doc_id is not null").select("doc_id", "_h1", "_h2").distinct()
    shared = own.groupBy("doc_id").agg(F.count("*").alias("_k")).where("_k > 1").select("doc_id")
    # ids below all others for the rows of such a doc_id
    low = F.least(F.coalesce(F.lit(own.agg(F.min("doc_id")).first()[0]).cast("bigint"), F.lit(0)), F.lit(0))
    clash = own.join(shared, "doc_id", "left_semi")
    clash = store.save(running(clash, [F.col("doc_id"), F.col("_h1"), F.col("_h2")], store).select("doc_id", "_h1", "_h2", (low - F.col("rank")).alias("_own")), "clash")
    if clash.isEmpty():
        named = d.withColumn("_own", F.col("doc_id"))
    else:
        named = d.join(clash, ["doc_id", "_h1", "_h2"], "left").withColumn("_own", F.coalesce("_own", "doc_id"))
    comp = store.save(jaccard_components(named.select(F.col("_own").alias("doc_id"), "text"), store).select("doc_id", "component_id").distinct(), "members")
    real = clash.select(F.col("_own"), F.col("doc_id").alias("_real"))
    placed = comp.join(real, F.col("doc_id") == F.col("_own"), "left").select(F.col("doc_id").alias("_id"), "component_id", F.coalesce("_real", "doc_id").alias("_real"))
    stays = placed.groupBy("component_id").agg(F.min(F.struct("_real", F.col("_id"))).alias("s")).select(F.col("s._id").alias("_own"))
    with_id = named.where("doc_id is not null").join(stays, "_own", "left_semi").dropDuplicates(["_own"])
    return with_id.select("_row.*").unionByName(docs.where("doc_id is null"))
