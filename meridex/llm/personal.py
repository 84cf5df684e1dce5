"""Personal data by patterns, and by a skip-chain conditional random field over what the patterns leave.

The nodes of a document's field are its tokens that hold a digit or a sign of an address. Tokens that a pattern has matched are
observed; the others may be one of the four kinds or none. Neighbours share a potential of their labels, and so do distant
tokens that repeat or resemble one another (the same last digits, the same local part, the same text but for marks), so that a
number that was matched in one place is also found where it stands without its prefix, with other separators or torn in two.
Labels come from loopy message passing over all documents of a block at once.

Weights are learnt here, by pseudo-likelihood, from a bounded sample of documents in which a pattern matches: copies of the
matches in other forms are to be found, numbers of the same forms with other digits are not.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.llm import _kit as K

# Kinds in the order in which spans of one start stand.
KINDS = ["email", "ip", "card", "phone"]

SAMPLE_MOST, TOKENS_MOST, LENGTH_MOST = 1000, 256, 80  # documents of the sample; tokens of each of them, and their length
SURE = 0.5  # least marginal of a span that the field adds
ROUNDS, CALM = 60, 1e-4  # of message passing: rounds at most, and the change under which it ends

_NONE = len(KINDS)
_LABELS = _NONE + 1
_FEATURES = 1 << 12
_FAR = -30.0  # logarithm that stands for impossible

# The patterns of the four kinds. Runs are possessive and begin at a run's first digit, so that a long run is read once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

_DIGITS, _AT = re.compile("[^0-9]+"), re.compile(r"@|\(at\)|\[at\]", re.I)
_SIGN = np.zeros(256, bool)
_SIGN[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and not overlapping within a kind; places are code points."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, end := m.end()))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


def features(token: str, before: str, after: str) -> list[int]:
    """Hashed features of a token between its neighbours of the field ('' where a neighbour is an ordinary word)."""
    shape = lambda t: re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", t)))[:16]
    n = len(_DIGITS.sub("", token))
    said = ["bias", f"shape {shape(token)}", f"digits {n if n < 20 else 20}", f"groups {min(9, len(re.findall('[0-9]+', token)))}", f"at {bool(_AT.search(token))}",
            f"before {shape(before)}", f"after {shape(after)}", f"alone {not before and not after}"]
    return [zlib.crc32(x.encode()) % _FEATURES for x in said]


def likeness(token: str) -> list[str]:
    """Keys under which a token resembles others of its document."""
    out, digits = [], _DIGITS.sub("", token)
    if len(digits) >= 7:
        out.append("d" + digits[-7:])
    if len(groups := re.findall("[0-9]+", token)) == 4:
        out.append("g" + ".".join(groups))
    m = _AT.search(token)
    if m and len(local := re.sub("[^a-z0-9]", "", token[: m.start()].lower())) >= 3:
        out.append("e" + local)
    if len(bare := re.sub(r"^\W+|\W+$", "", token.lower())) >= 5:
        out.append("t" + bare)
    return out


class Field:
    """Nodes and edges of many documents: a chain edge joins neighbouring tokens, a skip edge tokens alike."""

    def __init__(self) -> None:
        self.features: list[list[int]] = []
        self.seen: list[int] = []  # the label of an observed token, else -1
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def document(self, tokens: list[str], place: list[int], seen: list[int]) -> None:
        """tokens at their places among the document's words; neighbours are those whose places follow one another."""
        first, n = len(self.seen), len(tokens)
        near = [place[i + 1] == place[i] + 1 for i in range(n - 1)]
        keys: dict[str, list[int]] = defaultdict(list)
        for i, t in enumerate(tokens):
            self.features.append(features(t, tokens[i - 1] if i and near[i - 1] else "", tokens[i + 1] if i < n - 1 and near[i] else ""))
            for k in likeness(t):
                keys[k].append(first + i)
        self.chain += [(first + i, first + i + 1) for i in range(n - 1) if near[i]]
        self.seen += seen
        edges = set()
        for same in keys.values():
            anchor = next((i for i in same if self.seen[i] >= 0), None)
            edges.update(zip(same, same[1:], strict=False))  # each to the next, and to the first that is observed
            edges.update((min(anchor, i), max(anchor, i)) for i in same if i != anchor) if anchor is not None else None
        self.skip += sorted(edges)


class Weights:
    """Weights of features (by label), of neighbouring labels, and of the label that tokens alike share."""

    def __init__(self) -> None:
        self.unary = np.zeros((_FEATURES, _LABELS))
        self.chain = np.zeros((_LABELS, _LABELS))
        self.skip = np.zeros(_LABELS)

    def scores(self, f: Field) -> np.ndarray:
        return self.unary[np.array(f.features)].sum(1)


def _pairs(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.int64).reshape(-1, 2)


def fit(f: Field, truth: np.ndarray, steps: int = 300, rate: float = 0.1, shrink: float = 1e-4) -> Weights:
    """Weights of greatest pseudo-likelihood of the tokens that are not observed, given the true labels around each."""
    w, free = Weights(), np.array(f.seen) < 0
    idx, chain, skip = np.array(f.features), _pairs(f.chain), _pairs(f.skip)
    n, one = len(truth), np.eye(_LABELS)[truth]
    alike = np.zeros((n, _LABELS))
    np.add.at(alike, skip[:, 0], one[skip[:, 1]])
    np.add.at(alike, skip[:, 1], one[skip[:, 0]])
    left, right = np.zeros((n, _LABELS)), np.zeros((n, _LABELS))
    left[chain[:, 1]], right[chain[:, 0]] = one[chain[:, 0]], one[chain[:, 1]]
    params = [w.unary, w.chain, w.skip]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        z = w.unary[idx].sum(1) + left @ w.chain + right @ w.chain.T + alike * w.skip
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        d = (p / p.sum(1, keepdims=True) - one) * free[:, None] / max(1, free.sum())
        unary = np.stack([np.bincount(idx.ravel(), np.repeat(d[:, y], idx.shape[1]), _FEATURES) for y in range(_LABELS)], 1)
        for k, (v, g) in enumerate(zip(params, [unary, left.T @ d + d.T @ right, (alike * d).sum(0)], strict=True)):
            g = g + shrink * v
            mean[k], var[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * var[k] + 0.001 * g * g
            v -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return w


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(f: Field, w: Weights) -> np.ndarray:
    """Beliefs over the labels of each node after message passing; observed nodes are certain."""
    own = w.scores(f)
    seen = np.array(f.seen)
    own[seen >= 0] = _FAR
    own[seen >= 0, seen[seen >= 0]] = 0.0
    chain, skip = _pairs(f.chain), _pairs(f.skip)
    kind = np.repeat([0, 1], [len(chain), len(skip)])
    ends = np.concatenate([chain, skip])
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    m = len(ends)
    table = np.stack([w.chain, np.diag(w.skip), w.chain.T])
    psi = table[np.concatenate([kind, np.where(kind == 0, 2, 1)])]  # [message, label of its source, of its target]
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    msg = np.zeros((2 * m, _LABELS))
    gather = lambda: own + np.stack([np.bincount(target, msg[:, y], len(own)) for y in range(_LABELS)], 1)
    for _ in range(ROUNDS if m else 0):
        new = _logsum((gather()[source] - msg[back])[:, :, None] + psi, 1)
        new -= _logsum(new, 1)[:, None]
        change = np.abs(new - msg).max()
        msg = 0.5 * msg + 0.5 * new
        if change < CALM:
            break
    b = gather()
    return np.exp(b - _logsum(b, 1)[:, None])


def _tokens(raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(place among the row's words, start, end in code points) of the tokens with a digit or a sign of an address, by row."""
    s, e, row = K.words(raw, off)
    sign = _SIGN[raw]
    if len(raw) > 3:  # (at), [at]
        low = raw | 0x20
        sign[:-3] |= ((raw[:-3] == 40) | (raw[:-3] == 91)) & (low[1:-2] == 97) & (low[2:-1] == 116) & ((raw[3:] == 41) | (raw[3:] == 93))
    upto, chars = np.concatenate([[0], np.cumsum(sign)]), np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    place = np.arange(len(s)) - np.searchsorted(row, row)
    out: dict[int, list] = defaultdict(list)
    for k in np.flatnonzero(upto[e] > upto[s]):
        r, base = int(row[k]), chars[off[row[k]]]
        out[r].append((int(place[k]), int(chars[s[k]] - base), int(chars[e[k]] - base)))
    return out


def _observed(tokens: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """For each token the kind of the first pattern span that it meets, by the order of kinds, else -1."""
    out = [-1] * len(tokens)
    for kind in range(len(KINDS)):
        own, k = [(a, b) for a, x, b in spans if x == kind], 0
        for i, (_, s, e) in enumerate(tokens):
            while k < len(own) and own[k][1] <= s:
                k += 1
            if out[i] < 0 and k < len(own) and own[k][0] < e:
                out[i] = kind
    return out


def _blocks(col: pa.Array) -> Iterator[tuple[int, int, dict]]:
    """Row ranges of a column of texts with the tokens of their rows."""
    raw, off = K.utf8(col)
    for i, j in K.pieces(off):
        yield i, j, _tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tokens", pa.list_(pa.string())), ("place", pa.list_(pa.int64())), ("seen", pa.list_(pa.int32())), ("o", pa.int64())])
    for b in batches:
        out = []
        for i, _, found in _blocks(b.column("text")):
            for r, tokens in found.items():
                if len(tokens) <= TOKENS_MOST and all(e - s <= LENGTH_MOST for _, s, e in tokens):
                    text = b.column("text")[i + r].as_py()
                    seen = _observed(tokens, pattern_spans(text))
                    if max(seen) >= 0:
                        out.append({"tokens": [text[s:e] for _, s, e in tokens], "place": [p for p, _, _ in tokens], "seen": seen, "o": zlib.crc32(text.encode())})
        yield pa.RecordBatch.from_pylist(out, schema)


def variants(kind: int, text: str) -> list[str]:
    """Other forms of a match that no pattern takes."""
    if kind == 0:
        local, _, domain = text.partition("@")
        return [f"{local}(at){domain}", f"{local}@{domain.split('.')[0]}", f"{local}[at]{domain.replace('.', '[dot]')}"]
    groups = re.findall("[0-9]+", text)
    if kind == 1:
        return [",".join(groups), "-".join(groups), "[.]".join(groups), "_".join(groups)]
    d = "".join(groups)
    if kind == 2:
        return [sep.join(d[k : k + 4] for k in range(0, len(d), 4)) for sep in (".", "_", "/")]
    own = d[-10:]
    return [f"({own[:-7]}) {own[-7:-4]}-{own[-4:]}", f"{own[:-7]}-{own[-7:-4]}-{own[-4:]}", f"{own[:-7]}.{own[-7:-4]}.{own[-4:]}", own, f"{own[-7:-4]}-{own[-4:]}"]


def _other(text: str, rng: random.Random) -> str:
    """The same form with other digits and letters."""
    return "".join(str(rng.randrange(10)) if "0" <= c <= "9" else rng.choice("abcdefghijklmnoprstuvw") if c.isalpha() and "at" not in text[max(0, k - 1) : k + 2] else c for k, c in enumerate(text))


def train(rows: list[dict], seed: int = 7) -> Weights | None:
    """Weights from sampled documents (tokens, place, seen); None without any."""
    if not rows:
        return None
    rng, f, truth = random.Random(seed), Field(), []
    for r in rows:
        matched = {k for t, y in zip(r["tokens"], r["seen"], strict=True) if y >= 0 for k in likeness(t)}
        # what resembles a match of its document is neither: it has no part in what is learnt
        known = [x for x in zip(r["tokens"], r["place"], r["seen"], strict=True) if x[2] >= 0 or matched.isdisjoint(likeness(x[0]))]
        tokens, place, seen = (list(c) for c in zip(*known, strict=True))
        label = [k if k >= 0 else _NONE for k in seen]
        matches, i = [], 0
        while i < len(tokens):  # matches as runs of observed neighbours
            j = i + 1
            while j < len(tokens) and seen[i] >= 0 and seen[j] == seen[i] and place[j] == place[j - 1] + 1:
                j += 1
            matches += [(seen[i], " ".join(tokens[i:j]))] if seen[i] >= 0 else []
            i = j
        for kind, text in matches:
            bare = re.sub(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z]+$", "", text)
            for form in rng.sample(variants(kind, bare), rng.choice((1, 1, 2))):
                for said, y in ((form, kind), *((_other(form, rng), _NONE) for _ in range(3))):
                    at = place[-1] + 2  # a word stands between
                    for k, t in enumerate(said.split()):
                        tokens.append(t)
                        place.append(at + k)
                        seen.append(-1)
                        label.append(y)
        f.document(tokens, place, seen)
        truth += label
    return fit(f, np.array(truth))


def _added(tokens: list[tuple[int, int, int]], belief: np.ndarray, spans: list[tuple[int, int, int]], seen: list[int], text: str) -> list[tuple[int, int, int]]:
    """Spans of neighbouring tokens that the field gives one kind, without the marks around them, where no pattern span stands."""
    label = [_NONE if s >= 0 or b.max() < SURE else int(b.argmax()) for s, b in zip(seen, belief, strict=True)]
    out, i, k = [], 0, 0
    while i < len(tokens):
        j = i + 1
        if label[i] != _NONE:
            while j < len(tokens) and label[j] == label[i] and tokens[j][0] == tokens[j - 1][0] + 1:
                j += 1
            start, end = tokens[i][1], tokens[j - 1][2]
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            while k < len(spans) and spans[k][2] <= start:
                k += 1
            if start < end and not any(a < end and start < b for a, _, b in spans[k:]):
                out.append((start, label[i], end))
        i = j
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _find(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            col = b.column("text")
            for i, j, found in _blocks(col):
                field, docs = Field(), {}
                for r, tokens in found.items():
                    text = col[i + r].as_py()
                    spans = pattern_spans(text)
                    docs[r] = (tokens, spans, _observed(tokens, spans), text, len(field.seen))
                    if w is not None:
                        field.document([text[s:e] for _, s, e in tokens], [p for p, _, _ in tokens], docs[r][2])
                belief = marginals(field, w) if field.seen else None
                out = [[] for _ in range(j - i)]
                for r, (tokens, spans, seen, text, at) in docs.items():
                    more = _added(tokens, belief[at : at + len(tokens)], spans, seen, text) if belief is not None else []
                    every = sorted([(*x, True) for x in spans] + [(*x, False) for x in more])
                    out[r] = [{"kind": KINDS[k], "start": s, "end": e, "base": base} for s, k, e, base in every]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, base) of each row of docs (doc_id, text), by start, then kind.

    base: a pattern's match; the others are the field's, and never overlap one. Places are code points, ends exclusive. The field
    is fitted on at most SAMPLE_MOST documents with a match, of at most TOKENS_MOST tokens each, one for each class of a hash of their text;
    without any, there are pattern matches alone. Null and empty texts have no spans; repeated rows each get a row; a null
    doc_id stays null; other columns are ignored; an empty table gives an empty result. Every text is read whole; no shuffle.
    """
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = x.select("text").mapInArrow(_sample, "tokens array<string>, place array<bigint>, seen array<int>, o bigint")
    least = sample.groupBy((F.col("o") % SAMPLE_MOST).alias("part")).agg(F.min(F.struct("o", "tokens", "place", "seen")).alias("s"))  # combined in each task
    rows = [r.s.asDict() for r in least.orderBy("part").collect()]
    weights = docs.sparkSession.sparkContext.broadcast(train(rows))
    return x.mapInArrow(_find(weights), "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and a hash of the pattern matches of each document, and all its spans as one string."""
    say = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return personal_data(docs).select("doc_id", *counts, F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))
