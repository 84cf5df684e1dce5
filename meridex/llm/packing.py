"""Best-fit packing with bound-certified repacking.

Documents are tokenised, closed with an end id, and cut only where longer than a sequence. Pieces
that fill a sequence stand alone; the others are dealt over partitions of bounded size, each packed by
best-fit decreasing. Dual-feasible functions give a lower bound on each partition's number of bins.
A partition that meets its bound is certified and done. The others keep their well-filled bins and
hand the documents of bins with gaps to an exchange, where they are dealt over fewer partitions and packed
anew; the old bins stay wherever that saves none.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.llm.tokens import CACHE_MOST, load, spelled
from meridex.session import Store

PART = 40_000  # pieces that one task packs, about
ROUNDS = 3


class Ids(dict):
    """Token ids, as little-endian bytes, of the units between blanks; a bounded cache of one worker."""

    def __init__(self, tok):
        self.tok, self.model = tok, tok.model
        self[""] = b""

    def __missing__(self, w: str) -> bytes:
        body = w.rstrip(".,!?;:|")
        if body.isalpha() and max(body) <= "ɏ" and "İ" not in body:
            # letters that are in normal form already, one pre-token, and perhaps a run of marks, another one
            low = body.lower()
            got = array("I", [x.id for x in self.model.tokenize(low if low.isascii() else spelled(low))]).tobytes() if low == w else self[low] + self[w[len(body) :]]
        else:
            got = np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= 2 * CACHE_MOST:
            self.clear()
            self[""] = b""
        self[w] = got
        return got


def _cut(spec, size: int):
    """Pieces of each text: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        ids = Ids(load(spec.value))
        step = 4 * size
        for b in batches:
            col = b.column("text")
            row, piece, length, crc = [], [], [], []
            for i, t in enumerate(col):
                t = t.as_py() or ""
                got = b"".join(map(ids.__getitem__, t.replace("\n", " ").split(" "))) + b"\0\0\0\0"
                for k, a in enumerate(range(0, len(got), step)):
                    part = got[a : a + step]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([k * size for k in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual-feasible functions."""
    n = np.bincount(lengths, minlength=size + 1).astype(float)
    x = np.arange(size + 1)
    best = (n * x).sum() / size
    for eps in range(1, size // 2 + 1, max(1, size // 256)):  # large ones count as whole, small ones as nothing
        best = max(best, n[size - eps + 1 :].sum() + (n * x)[eps : size - eps + 1].sum() / size)
    for k in range(1, 20):  # rounding down to multiples of 1 / k
        whole = (k + 1) * x % size == 0
        best = max(best, (n * np.where(whole, x / size, (k + 1) * x // size / k)).sum())
    return int(np.ceil(best - 1e-9))


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins, by best-fit decreasing."""
    bins, offs = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        m = mask >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            b, r = used, size
            used += 1
        bins[i], offs[i] = b, size - r
        if r > n:
            free[r - n].append(b)
            mask |= 1 << (r - n)
    return bins, offs, used


def _pack(size: int, round_: int, last: bool):
    def run(key, table):
        part = key[0].as_py()
        t = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        n = t["length"].to_numpy()
        bins, offs, used = best_fit(n, size)
        seq = (np.int64(round_) << 58) + (np.int64(part) << 24) + bins
        old = t["sequence_id"].to_numpy() if round_ else None
        if old is not None and used >= len(np.unique(old)):  # nothing saved: the old bins stay
            seq, offs = old, t["offset"].to_numpy()
        u, inv = np.unique(seq, return_inverse=True)
        fill = np.bincount(inv, weights=n)
        done = np.full(len(n), True) if last or len(u) <= lower_bound(n, size) else (fill >= size - size // 64)[inv]
        cols = [t[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*cols, pa.array(seq), pa.array(offs), pa.array(done)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "done"])

    return run


_OUT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, tokenizer_path: str, store: Store, size: int = 2048) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone, one piece of length 1. Repeated rows are packed each by
    itself; a null doc_id stays null; more columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    cut = store.save(docs.select("doc_id", "text").mapInArrow(_cut(spec, size), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"), "pieces")
    full = cut.where(f"length = {size}").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    out, todo = [full], cut.where(f"length < {size}")
    for k in range(ROUNDS):
        n = todo.count()
        if not n:
            break
        parts = max(-(-n // PART), min(2 * spark.sparkContext.defaultParallelism, n // 4000)) if not k else -(-n // PART)
        deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(k)), F.lit(max(1, parts)))
        got = store.save(todo.withColumn("part", deal).groupBy("part").applyInArrow(_pack(size, k, k == ROUNDS - 1), _OUT + ", done boolean"), f"round{k}")
        out.append(got.where("done").drop("done"))
        todo = got.where("not done").drop("done")
    result = out[0]
    for t in out[1:]:
        result = result.unionByName(t)
    return result
