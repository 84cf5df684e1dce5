"""All lexicons in one pass: a token automaton that finds every term with its affixes, and whether it is negated.

A text in normal form is its tokens between blanks. A token is looked up once in each batch: which terms its runs of Arabic
letters are, with which affixes, and which word of which longer term, of which negator, it may be. The rest are array
operations over all tokens of a batch: longer terms and negators are bit masks of neighbouring tokens, and the scope of a
negator is a look at the four tokens before. So one Python call a batch takes the place of a regular expression for each lexicon.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from meridex.functions import vocabulary as V
from meridex.functions.match import negators
from meridex.functions.textfn import term

#: Every lexicon of the rules, by a name of its own; the place of a name is its bit in a mask.
LEXICONS: dict[str, list[str]] = {
    **{f"rule.{k}": v for k, v in V.RULES.items()}, **{f"urgency.{k}": v for k, v in V.URGENCY.items()}, **{f"flag.{k}": v for k, v in V.RED_FLAGS.items()},
}

_RUN = re.compile("[ء-ي]+")
_CACHE_MOST, _CACHED_LENGTH = 200_000, 64  # tokens that a worker remembers, and their length: about 50 MB


class _Sequences:
    """Sequences of words as bit masks: bit n of word j of a token says that it may be word j of sequence n."""

    def __init__(self, sequences: list[tuple[str, ...]]):
        self.sequences = sequences
        self.width = max(1, -(-len(sequences) // 64))
        self.longest = max(map(len, sequences), default=1)
        self.of_length = {k: self._mask(n for n, s in enumerate(sequences) if len(s) == k) for k in range(1, self.longest + 1)}

    def _mask(self, bits: Iterable[int]) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        for n in bits:
            out[n // 64] |= np.uint64(1 << (n % 64))
        return out

    def masks(self, may: list[list[list[int]]]) -> list[np.ndarray]:
        """may[token][j]: sequences whose word j the token may be; an array [token, width] for each j."""
        return [np.array([self._mask(t[j]) for t in may], np.uint64).reshape(-1, self.width) for j in range(self.longest)]

    def begin(self, words: list[np.ndarray], ids: np.ndarray, left: np.ndarray) -> dict[int, np.ndarray]:
        """For each length the mask, at every place, of the sequences that begin there; left: tokens from a place to its row's end."""
        out = {}
        for k, own in self.of_length.items():
            acc = words[0][ids] & own
            for j in range(1, k):
                follows = np.zeros_like(acc)
                follows[:-j or None] = words[j][ids][j:]
                acc &= follows
            acc[left < k] = 0
            out[k] = acc
        return out


class Automaton:
    """Finds the terms of named lexicons in texts in normal form."""

    def __init__(self, lexicons: Mapping[str, Iterable[str]]):
        self.names = list(lexicons)
        if len(self.names) > 63:
            raise ValueError("a mask has 63 lexicons at most")
        own: dict[tuple[str, ...], list[int]] = {}
        for k, terms in enumerate(lexicons.values()):
            for words in {tuple(term(t).split()) for t in terms}:
                own.setdefault(words, []).append(k)
        self.single = {w[0]: ks for w, ks in own.items() if len(w) == 1}
        self.terms = _Sequences([w for w in own if len(w) > 1])
        self.lexicons = [own[w] for w in self.terms.sequences]
        self.negators = _Sequences([tuple(n.split()) for n in negators() if n != V.ADJACENT])
        self.affixed = max((len(w) for s in own for w in s), default=0) + max(map(len, V.CLITICS)) + max(map(len, V.SUFFIXES))
        self.cache: dict[str, tuple] = {}

    def _bare(self, run: str, prefix: bool, suffix: bool) -> set[str]:
        """What a run may be without its affixes."""
        if len(run) > self.affixed:
            return set()
        starts = [run, *(run[len(p) :] for p in V.CLITICS if prefix and run.startswith(p))]
        return {*starts, *(r[: -len(s)] for r in starts for s in V.SUFFIXES if suffix and r.endswith(s))} - {""}

    def look_up(self, token: str) -> tuple:
        """Hits of single words (lexicon, start, end), sequences by word, negators by word, start of the last run, end of the first."""
        known = self.cache.get(token)
        if known is None:
            known = self._look_up(token)
            if len(token) <= _CACHED_LENGTH:
                if len(self.cache) >= _CACHE_MOST:
                    self.cache.clear()
                self.cache[token] = known
        return known

    def _look_up(self, token: str) -> tuple:
        runs = [m.span() for m in _RUN.finditer(token)]
        hits = [(k, s, e) for s, e in runs for k in sorted({k for w in self._bare(token[s:e], True, True) for k in self.single.get(w, ())})]
        first = self._bare(token[runs[-1][0] :], True, False) if runs and runs[-1][1] == len(token) else set()
        last = self._bare(token[: runs[0][1]], False, True) if runs and runs[0][0] == 0 else set()
        terms: list[list[int]] = [[] for _ in range(self.terms.longest)]
        for n, words in enumerate(self.terms.sequences if runs else ()):
            for j, w in enumerate(words):
                if w in first if j == 0 else w in last if j == len(words) - 1 else w == token:
                    terms[j].append(n)
        negs: list[list[int]] = [[] for _ in range(self.negators.longest)]
        for n, words in enumerate(self.negators.sequences if runs else ()):
            for j, w in enumerate(words):
                if w == token:
                    negs[j].append(n)
        return hits, terms, negs, runs[-1][0] if runs else 0, runs[0][1] if runs else 0

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int, bool]]]:
        """For each text its hits (lexicon, start, end, negated) by start, then lexicon; where a lexicon hits a place twice, the longer one."""
        out: list[list] = [[] for _ in range(len(texts))]
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        flat = lists.flatten().dictionary_encode()
        ids, tokens = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        count = np.diff(ends)
        row = np.repeat(np.arange(len(count)), count)
        place, left = np.arange(len(ids)) - ends[row], ends[row + 1] - np.arange(len(ids))
        length = np.array([len(t) for t in tokens], np.int64)[ids] + 1
        before = np.cumsum(length) - length
        start = before - before[ends[row]]
        known = [self.look_up(t) for t in tokens]
        negated, inside = self._negated(tokens, known, ids, place, left)

        def emit(i: int, k: int, s: int, end: int) -> None:
            piece = tokens[ids[i]][:s]
            out[row[i]].append((int(start[i]) + s, k, end, bool(inside[i]) and piece not in V.BREAKERS if piece else bool(negated[i])))

        for i in np.flatnonzero(np.array([bool(x[0]) for x in known], bool)[ids]):
            for k, s, e in known[ids[i]][0]:
                emit(i, k, s, int(start[i]) + e)
        for n, begun in self.terms.begin(self.terms.masks([x[1] for x in known]), ids, left).items():
            for i in np.flatnonzero(begun.any(1)):
                for t in (w * 64 + b for w, bits in enumerate(map(int, begun[i])) for b in range(64) if bits >> b & 1):
                    for k in self.lexicons[t]:
                        emit(i, k, known[ids[i]][3], int(start[i + n - 1]) + known[ids[i + n - 1]][4])
        best = [{(s, k): (k, s, e, neg) for s, k, e, neg in sorted(hits)} for hits in out]
        return [list(b.values()) for b in best]

    def _negated(self, tokens: list[str], known: list[tuple], ids: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each token, whether a term that begins it is negated, and whether one that begins inside it is, if what stands before ends no scope."""
        ended = np.zeros(len(ids), bool)  # a negator ends with this token
        for k, begun in self.negators.begin(self.negators.masks([x[2] for x in known]), ids, left).items():
            at = np.flatnonzero(begun.any(1))
            ended[at + k - 1] = True
        is_ = lambda words: np.array([t in words for t in tokens], bool)[ids]
        stops, either, adjacent = is_(set(V.BREAKERS)), is_({V.OR}), is_({V.ADJACENT})

        def back(a: np.ndarray, k: int) -> np.ndarray:
            """a as it was k tokens before, within the row."""
            b = np.zeros(len(a), bool)
            b[k:] = a[: max(0, len(a) - k)]
            return b & (place >= k)

        open1 = ~back(stops, 1)
        open2 = open1 & ~back(stops, 2)
        near2, or2 = back(ended, 1) | (back(ended, 2) & open1), back(either, 1) | back(either, 2)
        negated = near2 | (back(ended, 3) & open2) | (back(ended, 4) & open2 & ~back(stops, 3) & (or2 | back(either, 3))) | back(adjacent, 1)
        return negated, near2 | (back(ended, 3) & open2 & or2)


#: Eight tokens or more without Arabic letters: they hold no term, and no scope reaches over them.
_FAR_APART, _APART = "(?:[^ء-ي ]++ ){8,200}+", "- - - - - - - - "

_ready: dict[tuple, Automaton] = {}


def _automaton(lexicons: tuple) -> Automaton:
    """One for each worker and set of lexicons."""
    if lexicons not in _ready:
        _ready.clear()
        _ready[lexicons] = Automaton({k: list(v) for k, v in lexicons})
    return _ready[lexicons]


_SPAN = pa.struct([("lexicon", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("negated", pa.bool_())])


def _arabic(c: Column) -> Column:
    """c where it holds an Arabic letter, else null: other texts are not handed to Python."""
    return F.when(c.rlike("[ء-ي]"), c)


def _frozen(lexicons: Mapping[str, Iterable[str]] | None) -> tuple:
    return tuple((k, tuple(v)) for k, v in (LEXICONS if lexicons is None else lexicons).items())


def spans(c: Column, lexicons: Mapping[str, Iterable[str]] | None = None) -> Column:
    """array<struct<lexicon, start, end, negated>> of every term of every lexicon in the normal form c, by start, then lexicon.

    Places are characters, affixes included, ends exclusive. A null text, or one without Arabic letters, has none.
    """
    own = _frozen(lexicons)

    @F.arrow_udf("array<struct<lexicon:string,start:int,end:int,negated:boolean>>")
    def find(texts: pa.Array) -> pa.Array:
        a = _automaton(own)
        return pa.array([[{"lexicon": a.names[k], "start": s, "end": e, "negated": n} for k, s, e, n in hits] for hits in a.scan(texts)], pa.list_(_SPAN))

    return find(_arabic(c))


def free_mask(c: Column, lexicons: Mapping[str, Iterable[str]] | None = None) -> Column:
    """bigint whose bit k says that a term of lexicon k stands somewhere in the normal form c without negation."""
    own = _frozen(lexicons)

    @F.arrow_udf("bigint")
    def find(texts: pa.Array) -> pa.Array:
        masks = []
        for hits in _automaton(own).scan(texts):
            m = 0
            for k, _, _, negated in hits:
                m |= 0 if negated else 1 << k
            masks.append(m)
        return pa.array(masks, pa.int64())

    near = F.regexp_replace(_arabic(c), _FAR_APART, _APART)  # what stands between is shortened before it is handed over
    return F.coalesce(find(near), F.lit(0).cast("bigint"))


_PLACE = {name: k for k, name in enumerate(LEXICONS)}


def holds(mask: Column, name: str) -> Column:
    """Whether free_mask() of the own lexicons has the one of this name."""
    return mask.bitwiseAND(F.lit(1 << _PLACE[name]).cast("bigint")) != 0
