"""Top-k vector search: an exact one that needs no random access, and one over a permutation index.

Both deal queries and candidates, in blocks of bounded size, over a grid of cells; a cell returns its own
top k for each of its queries, and a ranking by query joins the cells' results. The grid is fixed by counts, so
a cell's memory does not grow with the input, and repeated or near-equal vectors cannot fill one task.

Vectors that are null or hold null or non-finite components take no part (for cosine, zero vectors too), nor
do rows without a vec_id. Of rows that repeat a vec_id, the least vector counts. Vectors are compared only with
those of the same length. An empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CELL_ROWS = 16_384
CELL_QUERIES = 256
#: Rows whose sorted lists are read at once; the scores reached so far bound the next ones. Shares of the lists read in each step.
LIST_ROWS = 4096
DEPTHS = (0.125, 0.25, 0.5, 1.0)
#: Pivots are the first PIVOTS of a bounded sample (4 * PIVOTS vectors, by hash of vec_id) that lie apart, with no
#: two at a cosine of APART or more, so that a crowd of near-equal vectors counts once. Each vector keeps its PERM nearest.
PIVOTS = 256
APART = 0.9
PERM = 64
#: Candidates reranked for each query of a cell: this share of it by footrule distance, at least LEAST, ties included, ...
SHARE = 0.15
LEAST = 1024
#: ... and all whose posting score reaches this share of the k-th best.
CLOSE = 0.75


def usable(emb: DataFrame, nonzero: bool = False) -> DataFrame:
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = emb.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(ok & fine)
    if nonzero:
        v = v.where(F.exists("embedding", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("v")).withColumn("dim", F.size("v"))


def _grid(vecs: DataFrame, every: int, cell, schema: str, k: int) -> DataFrame:
    spark = vecs.sparkSession
    n, q = vecs.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    cores = max(2, spark.sparkContext.defaultParallelism)
    nc = max(-(-n // CELL_ROWS), min(cores, n // 2000), 1)
    nq = max(-(-q // CELL_QUERIES), min(-(-2 * cores // nc), q // 32), 1)
    mine = lambda c, m, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(m)).cast("int")
    rows = vecs.select("dim", mine("vec_id", nc, 1).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"), "vec_id", "v")
    asks = vecs.where(F.col("vec_id") % every == 0).select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("c"), mine("vec_id", nq, 2).alias("q"), "vec_id", "v")
    got = rows.groupBy("dim", "c", "q").cogroup(asks.groupBy("dim", "c", "q")).applyInArrow(cell, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(by)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t["vec_id"].to_numpy()
    col = t["v"].combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return ids, np.asarray(col.flatten()).reshape(len(ids), -1)


def nra(x: np.ndarray, asks: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> list[np.ndarray]:
    """For each query, the columns of x that may be among its k best inner products, by sorted access alone.

    x: a list of whole values for each component (components x rows); asks: queries x components; own: each query's own
    column, or -1; least: a score that k others are known to reach. Each list is read from its best end for a query, all
    queries in step. lower: what a row has surely; upper: what it can have, its unread components standing at most at
    the list's frontier. A query stops reading when few rows can still qualify; ties are among them. What has been read to a depth
    is the same for all queries of one sign, so the bounds of all queries are products of matrices, exact below 2**53.
    """
    d, n = x.shape
    rank = np.argsort(np.argsort(x, axis=1, kind="stable"), axis=1, kind="stable")
    sort = np.sort(x, axis=1)
    worst = np.minimum(asks * sort[:, 0], asks * sort[:, -1])
    up, out = asks > 0, [np.zeros(0, np.int64)] * len(asks)
    todo = np.arange(len(asks))
    for share in DEPTHS:
        depth = max(1, int(n * share))
        high, low = rank >= n - depth, rank < depth
        front = np.where(up[todo], asks[todo] * sort[:, n - depth], asks[todo] * sort[:, depth - 1]) - worst[todo]
        read = np.concatenate([high, low]).astype(float)
        sides = lambda z: np.concatenate([np.where(up[todo], z, 0), np.where(up[todo], 0, z)], axis=1)
        sure = sides(asks[todo]) @ (np.concatenate([x, x]) * read) - sides(worst[todo]) @ read + worst[todo].sum(1)[:, None]
        most = sure + front.sum(1)[:, None] - sides(front) @ read
        has = np.flatnonzero(own[todo] >= 0)
        sure[has, own[todo][has]] = most[has, own[todo][has]] = -np.inf
        kth = np.maximum(least[todo], np.partition(sure, n - k, axis=1)[:, n - k] if n > k else -np.inf)
        open_ = (most >= kth[:, None]) & (most > -np.inf)
        done = (open_.sum(1) <= max(4 * k, n // 32)) | (share == DEPTHS[-1])
        for i in np.flatnonzero(done):
            out[todo[i]] = np.flatnonzero(open_[i])
        todo = todo[~done]
        if not len(todo):
            break
    return out


_SCORE = "query_id bigint, vec_id bigint, score {}"


def exact_topk(emb: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """For each query (vec_id divisible by `every`): query_id, rank, vec_id, score, by integer inner product.

    Components become floor(scale * x). Ties go to the smaller vec_id. See the module for nulls and repeats. Raises OverflowError
    where components are so large that scores may reach 2**53, where they would no more be exact.
    """
    vecs = usable(emb)

    def cell(_key, left, right):
        ids, m = _matrix(left)
        asks, qs = _matrix(right)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(asks):
            if m.shape[1] * float(np.abs(m).max() * scale + 1) * float(np.abs(qs).max() * scale + 1) >= 2.0**53:
                raise OverflowError("exact_topk: scores may reach 2**53")
            o = np.argsort(ids)
            ids, x, q = ids[o], np.floor(m[o] * scale).T, np.floor(qs * scale)
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asks)
            for a in range(0, len(ids), LIST_ROWS):
                part, mine = np.ascontiguousarray(x[:, a : a + LIST_ROWS]), ids[a : a + LIST_ROWS]
                at = np.searchsorted(mine, asks)
                own = np.where(mine[np.minimum(at, len(mine) - 1)] == asks, np.minimum(at, len(mine) - 1), -1)
                least = np.array([s[k - 1] if len(s) >= k else -np.inf for _, s in best])
                for i, rows in enumerate(nra(part, q, own, k, least)):
                    found, score = np.concatenate([best[i][0], mine[rows]]), np.concatenate([best[i][1], q[i] @ part[:, rows]])  # the finalists' scores, resolved
                    top = np.lexsort((found, -score))[:k]
                    best[i] = found[top], score[top]
            out = [(np.full(len(f), i), f, s.astype(np.int64)) for i, (f, s) in zip(asks, best, strict=True)]
        return _table(out, pa.int64())

    return _grid(vecs, every, cell, _SCORE.format("bigint"), k)


def _table(out: list, kind: pa.DataType) -> pa.Table:
    a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0), np.zeros(0))
    return pa.table([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c).cast(kind)], names=["query_id", "vec_id", "score"])


def permutation_search(emb: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """For each query (vec_id divisible by `every`): query_id, rank, vec_id, score, by cosine, over a permutation index.

    Every vector is posted in the inverted files of its nearest pivots with its rank there. A query reads its
    own pivots' files, which gives the footrule distance of the two permutations (a pivot that one of them lacks
    stands behind the last rank); the nearest by it are reranked by the exact cosine of the original vectors.
    Ties go to the smaller vec_id. See the module for nulls and repeats.
    """
    vecs = usable(emb, nonzero=True)
    pivots: dict[int, list[np.ndarray]] = {}
    picked = vecs.withColumn("h", F.xxhash64("vec_id", F.lit(42))).groupBy("dim", "v").agg(F.min("h").alias("h")).orderBy("h").limit(4 * PIVOTS).collect()
    for r in picked:
        p, kept = np.array(r.v) / np.linalg.norm(r.v), pivots.setdefault(r.dim, [])
        if len(kept) < PIVOTS and all(p @ x < APART for x in kept):
            kept.append(p)
    sent = vecs.sparkSession.sparkContext.broadcast({d: np.stack(p) for d, p in pivots.items()})

    def cell(_key, left, right):
        ids, m = _matrix(left)
        asks, qs = _matrix(right)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(asks):
            o = np.argsort(ids)
            ids, m = ids[o], m[o]
            norm = np.linalg.norm(m, axis=1)
            piv = sent.value.get(m.shape[1], m[:1] / norm[:1, None])
            depth = min(PERM, len(piv))
            perm = np.argsort(-(m @ piv.T) / norm[:, None], axis=1, kind="stable")[:, :depth]
            flat = np.argsort(perm, axis=None, kind="stable")  # the inverted files, one after another
            who, worth = flat // depth, (depth - flat % depth).astype(np.int32)
            at = np.searchsorted(perm.ravel()[flat], np.arange(len(piv) + 1))
            asked = np.argsort(-(qs @ piv.T), axis=1, kind="stable")[:, :depth]
            qn = np.linalg.norm(qs, axis=1)
            for i, q, z, mine in zip(asks, qs, qn, asked, strict=True):
                near = np.zeros(len(ids), np.int32)  # half of what the footrule distance falls short of its largest value
                for r, p in enumerate(mine):
                    s = slice(at[p], at[p + 1])
                    near[who[s]] += np.minimum(worth[s], depth - r)
                near[ids == i] = -1
                want = min(len(ids), max(LEAST, int(SHARE * len(ids))))
                top = np.partition(near, len(near) - want)[len(near) - want]
                kth = np.partition(near, max(0, len(near) - k))[max(0, len(near) - k)]
                rows = np.flatnonzero((near >= min(top, CLOSE * kth)) & (near >= 0))
                score = (m[rows] * q).sum(1) / (norm[rows] * z)
                best = np.lexsort((ids[rows], -score))[:k]
                out.append((np.full(len(best), i), ids[rows][best], score[best]))
        return _table(out, pa.float64())

    return _grid(vecs, every, cell, _SCORE.format("double"), k)
