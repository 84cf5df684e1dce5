"""Fill-in-middle transformation of whole Arrow batches.

A text's units are its lines. Two cuts between units split it into prefix, middle and suffix, which are written in another
order behind tags. The kernel sees a batch as one UTF-8 buffer and its offsets: a table classes each byte, a mask of adjacent
bytes finds where units begin, cumulative sums that start anew with each document number them, and one searchsorted finds the
cuts of all rows. No text becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridex.llm import _kit as K

# The tags before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_TAGS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
_NEWLINE, _INSIDE = 1, 2  # classes of bytes: a line's end; a character's second and later bytes
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x0A] = _NEWLINE
_CLASS[0x80:0xC0] = _INSIDE
_PLAIN, _PSM, _SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])


def _tagged(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row holds one of the tags."""
    found = np.zeros(len(off) - 1, bool)
    at = np.flatnonzero((raw[:-2] == _TAGS[0]) & (raw[2:] == _TAGS[2]) & np.isin(raw[1:-1], _TAGS[1::3])) if len(raw) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(off, at, "right") - 1
    found[row[at + 3 <= off[row + 1]]] = True
    return found


def _cuts(raw: np.ndarray, off: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of each row, the byte where its prefix and its middle end, and characters before each byte."""
    kind, begin, end = _CLASS[raw], off[:-1], off[1:]
    first = np.zeros(len(raw), bool)
    first[1:] = kind[:-1] == _NEWLINE
    first[begin[end > begin]] = True
    upto = np.cumsum(first)  # units begun up to each byte
    before = np.concatenate([[0], upto])[begin]  # ... and before each document, from which its own count starts
    n = np.concatenate([[0], upto])[end] - before
    a, b = h1 % (n + 1), h2 % (n + 1)
    cut = lambda k: np.minimum(np.searchsorted(upto, before + k + 1), end)  # noqa: E731  the byte where unit k of the document begins
    return n, cut(np.minimum(a, b)), cut(np.maximum(a, b)), np.concatenate([[0], np.cumsum(kind != _INSIDE)])


def _joined(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes source[start:start + size] of all segments, one after the other."""
    if len(start) <= 6:  # one long text: its segments are copied, not gathered by index
        return np.concatenate([source[s : s + k] for s, k in zip(start, size, strict=True)])
    where = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    return source[where]


def transform(raw: np.ndarray, off: np.ndarray, h: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, ...]:
    """Units, form, characters of prefix and middle, output bytes and their offsets, for all rows of one buffer.

    raw: the rows' bytes alone; off: offsets, the first of them 0; h: four hashes a row.
    """
    n, p, m, chars = _cuts(raw, off, h[0], h[1])
    begin, end = off[:-1], off[1:]
    form = np.where((end == begin) | _tagged(raw, off) | (h[2] % 100 >= rate), _PLAIN, np.where(h[3] % 100 < spm, _SPM, _PSM))
    source, t = np.concatenate([_TAGS, raw]), len(_TAGS)
    tag = lambda k: (np.full(len(n), 3 * k), np.full(len(n), 3))
    prefix, middle, suffix = (begin + t, p - begin), (p + t, m - p), (m + t, end - m)
    none = (np.zeros(len(n), np.int64),) * 2
    segments = {
        _PLAIN: [(begin + t, end - begin), none, none, none, none, none],
        _PSM: [tag(0), prefix, tag(1), suffix, tag(2), middle],
        _SPM: [tag(1), suffix, tag(0), prefix, tag(2), middle],
    }
    start, size = (np.stack([np.choose(form, [segments[f][k][i] for f in (_PLAIN, _PSM, _SPM)]) for k in range(6)], 1) for i in (0, 1))
    return n, form, chars[p] - chars[begin], chars[m] - chars[p], _joined(source, start.ravel(), size.ravel()), np.concatenate([[0], np.cumsum(size.sum(1))])


def _run(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = K.utf8(b.column("text"))
            h = np.stack([b.column(f"h{k}").to_numpy() for k in range(1, 5)]) if len(b) else np.zeros((4, 0), np.int64)
            for i, j in K.pieces(off):
                n, form, pc, mc, out, ends = transform(raw[off[i] : off[j]], off[i : j + 1] - off[i], h[:, i:j], rate, spm)
                if ends[-1] > 2**31 - 1:
                    raise ValueError("a text of 2 GB")
                text = pa.StringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))
                none = form == _PLAIN
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(FORMS[form]), pa.array(pc, mask=none), pa.array(mc, mask=none), text],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output of each row of docs (doc_id, text).

    rate: of 100 texts, so many are transformed; spm: of 100 of these, so many with the suffix first. Cuts and forms come from
    sha256 of `seed:doc_id`, so reruns agree. A null text counts as empty, and an empty text, or one that holds a tag, stays
    plain; a null doc_id hashes as an empty one. Repeated rows each get a row; other columns are ignored; an empty table gives
    an empty result. A row is transformed where it stands: no shuffle, and memory for one batch.
    """
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    x = x.withColumn("digest", digest).select("doc_id", "text", *[F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)])
    return x.mapInArrow(_run(rate, spm), "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column) -> Column:
    """The text from which an output was made: a transformed text holds each tag once, whatever its parts are."""
    part = lambda tag, upto: F.split_part(F.split_part(output, F.lit(tag), F.lit(2)), F.lit(upto), F.lit(1))
    last = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(part(PREFIX, SUFFIX), last, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), last, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **options) -> DataFrame:
    """fill_in_middle with hashes in place of the outputs, and of the texts rebuilt from them."""
    x = fill_in_middle(docs, **options)
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


INFILL_SQL = r"""
with t as (select doc_id, coalesce(text, '') as x, sha256('7:' || coalesce(doc_id::varchar, '')) as s from documents),
h as (select doc_id, x, regexp_extract_all(x, '[^\n]*\n|[^\n]+') as u, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from t),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from h),
p as (select doc_id, x, n, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s,
case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(p || m || s) as restored_sha256 from p
"""
