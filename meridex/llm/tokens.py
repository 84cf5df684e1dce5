"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their token lengths, found by one counting
pass over all texts (each task keeps a bounded lossy count and hands on its most frequent pre-tokens,
so no pre-token of a text is shuffled) and broadcast; its size is bounded by TABLE_MOST. Tier two is a
bounded cache in each Python worker, which the library's own encoder fills on a miss. The tables
only save work: every count is the library's.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.llm import _kit as K

TABLE_MOST = 1 << 16
TASK_MOST = 1 << 13
CACHE_MOST = 300_000
SPECIAL = "<|"

#: Two white spaces together, at an end, or of another kind than blank and newline: such texts take the slower path.
_ODD = re.compile(r"\s\s|^\s|\s\Z|[^\S \n]")
#: Characters on whose classes every Unicode version in use agrees.
_COMMON = re.compile(r"[\x00-ɏͰ-ͷΑ-ΡΣ-ϿА-яء-ي‐-‧€ぁ-ゖァ-ヺ一-龥]*\Z")

#: Byte-level vocabularies write a byte as one character: printable ones as themselves, the others, in order, from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_loaded: dict = {}


def spelled(pre: str) -> str:
    """A pre-token as a byte-level model spells it."""
    return pre.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTES)


def load(spec: str):
    """The tokenizer of a JSON text, once for each Python worker."""
    key = hash(spec)
    if key not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded.clear()
        _loaded[key] = Tokenizer.from_str(spec)
    return _loaded[key]


class Lengths(dict):
    """Token counts of pre-tokens: the broadcast table first, then this worker's cache."""

    def __init__(self, tok, table: dict):
        self.tok, self.table, self.model = tok, table, tok.model

    def __missing__(self, p: str) -> int:
        n = self.table.get(p)
        if n is None:
            n = len(self.model.tokenize(spelled(p)))
            if len(self) >= CACHE_MOST:
                self.clear()
            self[p] = n
        return n


class Units(dict):
    """Token counts of the units between blanks; `lead` is what stands before each of them."""

    def __init__(self, lead: str, lengths: Lengths, pattern):
        self.lead, self.lengths, self.pattern = lead, lengths, pattern

    def __missing__(self, w: str) -> int:
        n = whole(self.lead + w, self.lengths, self.pattern)
        if len(self) >= CACHE_MOST:
            self.clear()
        self[w] = n
        return n


def whole(text: str, lengths: Lengths, pattern) -> int:
    if SPECIAL in text or not _COMMON.match(text):
        return len(lengths.tok.encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, pattern.findall(text)))


def count(text: str | None, first: Units, rest: Units, newline: int) -> int:
    if not text:
        return 0
    if _ODD.search(text):
        return whole(text, rest.lengths, rest.pattern)
    n = text.count("\n") * newline
    for line in text.split("\n"):
        head, *tail = line.split(" ")
        n += first[head] + sum(map(rest.__getitem__, tail))
    return n


def _frequent(pattern_text: str):
    def run(batches):
        pattern, seen = regex.compile(pattern_text), Counter()

        def prune(most: int) -> None:
            nonlocal seen
            seen = Counter(dict(seen.most_common(most)))

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(t.split(" "))
            if len(seen) > 1_000_000:
                prune(200_000)
        prune(4 * TASK_MOST)
        pre = Counter()
        for w, c in seen.items():
            for p in pattern.findall(" " + w):
                pre[p] += c
        top = pre.most_common(TASK_MOST)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["p", "c"])

    return run


def _count_all(spec, table, pattern_text: str, limit: int):
    def run(batches):
        pattern = regex.compile(pattern_text)
        lengths = Lengths(load(spec.value), table.value)
        first, rest = Units("", lengths, pattern), Units(" ", lengths, pattern)
        newline = lengths["\n"]
        for b in batches:
            col = b.column("text")
            n = np.fromiter((count(t.as_py(), first, rest, newline) for t in col), np.int64, len(col))
            _, off = K.utf8(col)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row.

    tokenizer_path: a byte-level BPE file of the tokenizers library whose pre-tokens `pattern` splits.
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each get a row; a null doc_id stays
    null; more columns are ignored; an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec, tok = sc.broadcast(text), load(text)
    top = (docs.select("text").mapInArrow(_frequent(pattern), "p string, c bigint").groupBy("p").agg(F.sum("c").alias("c"))
           .orderBy(F.desc("c"), "p").limit(TABLE_MOST).collect())
    table = {r.p: len(e.ids) for r, e in zip(top, tok.encode_batch([r.p for r in top], add_special_tokens=False), strict=True) if SPECIAL not in r.p}
    return docs.select("doc_id", "text").mapInArrow(_count_all(spec, sc.broadcast(table), pattern, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
