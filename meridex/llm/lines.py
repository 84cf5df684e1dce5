"""Fuzzy line de-duplication: one occurrence of each group of near-equal lines stays in the corpus.

Lines of WORDS_FUZZY words or more (runs of letters) are normalised to their lower-case runs of letters and digits, which marks
and blanks only part; shorter ones, which words alone do not tell apart, to their lower-case characters with single blanks. Equal
normalised lines form a class, by a 128-bit hash. Each class of the first kind has a sketch: the minima of the hashes of its
runs of GRAM bytes, one for each of BINS bins. A run counts with the one of PARTS equal parts of its line that it begins in: long lines
of one language share most of their runs, but not at the same places, and near copies keep them there. Classes meet in lists by blocks of WIDTH minima, as many blocks (BANDS)
as it takes that lines with typing errors all over, at the edit similarity asked for, rarely miss each other in all of them.
In a list, two classes are candidates where PASS or more bins of their sketches agree (by 4 bits each). Candidates are
verified by edit similarity (those whose letters alone do not rule it out), linked classes form groups, and of each group the first occurrence, by doc_id and line, is kept.

A SimHash of 64 bits over the same runs would have to allow about 20 differing bits at that similarity, and one changed
letter in a line of 40 characters moves about 12: no block of useful length then stays equal. Minima keep the scheme of blocks, at
an agreement that falls with the share of changed runs. See the README for figures.

The list entries travel packed: a task sends one block of bytes to each bucket of lists. A first round verifies for each class
the partner before it, in an order by hashes, whose sketch agrees best, which makes trees of crowds; then only pairs not yet in one group are
verified, so a crowd of near copies never becomes all its pairs and no candidate that matters is lost. Texts are read again for
the sketches and for the candidates' lines, so that neither are stored or shuffled with all lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.llm import _kit as K
from meridex.operators.graph import connected_components
from meridex.session import Store

SIMILARITY = 0.9
#: Lines of fewer words are copies only where they are equal in full, but for case and blanks.
WORDS_FUZZY = 5
#: Shorter normalised lines cannot differ in a byte at this similarity; they have no sketch.
BYTES_LEAST = 10
GRAM, PARTS = 6, 6
BANDS, WIDTH, BINS, PASS = 14, 2, 31, 9
#: List entries of a bucket, about, and those that a task holds before it sends them.
BUCKET_ENTRIES = 1 << 19
FLUSH = 1 << 21
#: Partners before an entry after which the first round looks for no more, and one in how many entries of a list may be left without; the second round has no such bounds.
ENOUGH, LEFT = 4, 64
#: Documents are told apart by so many hash classes where only some of them have to be shuffled.
SIEVE = 1 << 20
#: Hash classes of lines, a bit each, that tell each task whose texts are wanted.
MARKS = 1 << 25
#: Rounds before the last one, at most, as long as a list has over CROWD pairs for each entry; they end when one links fewer than one class in FRUIT. Random places
#: of such a list that an entry looks at in each.
ROUNDS, CROWD, FRUIT, PROBES = 2, 32, 50, 16
#: Texts up to this length have their distances taken many at once.
WIDE = 2048
#: Characters of the runs that are counted before a distance is taken.
RUN = 3

_APART = np.ones(256, bool)
_APART[97:123] = False
_APART[128:] = False
#: Digits make no words, but they stay: lines that differ in their numbers are as far apart as these are.
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PART = K.mix(np.arange(PARTS, dtype=K.U), 37)
_OTHER = K.mix(np.arange(256, dtype=K.U), 31)


def _unspaced(raw: np.ndarray) -> np.ndarray:
    """Whether a character of a script without blanks begins at a byte: Thai, Lao, Burmese, Khmer, kana and Chinese characters."""
    a, b, c = raw, np.append(raw[1:], np.uint8(0)), np.append(raw[2:], np.zeros(min(2, len(raw)), np.uint8))[: len(raw)]
    south = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)
    khmer = (a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F))
    east = ((a == 0xE3) & (b > 0x80)) | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)) | ((a == 0xEF) & ((b == 0xBD) & (c >= 0xA6) | (b == 0xBE)))
    return south | khmer | east | ((a == 0xF0) & (b >= 0xA0) & (b <= 0xBF))


def _flat(raw: np.ndarray, inside: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words (runs of bytes that are `inside`) of lines lo..hi joined by blanks: bytes, and each line's start and end.

    A byte that is not inside stands at each hi.
    """
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    at = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(keep, out=at[1:])
    text = np.where(inside, raw, np.uint8(32))[keep]
    a, z = at[lo].astype(np.int64), at[hi + 1].astype(np.int64)
    return text, a, np.maximum(a, z - 1)


def _hash2(text: np.ndarray, a: np.ndarray, z: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of text[a:z]."""
    p, q = K._powers(len(text) + 1)
    out = []
    with np.errstate(over="ignore"):
        for k, values in enumerate((text.astype(K.U) + K.U(1), _OTHER[text])):
            total = np.zeros(len(text) + 1, K.U)
            np.cumsum(values * p[: len(text)], out=total[1:])
            out.append(K.mix(((total[z] - total[a]) * q[a]) ^ ((z - a).astype(K.U) << K.U(40)), salt + k))
    return out[0], out[1]


def sketches(text: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Minima of 32-bit hashes of the runs of GRAM bytes of text[a:z] and their parts of it, by line and bin. Each line has GRAM bytes or more.

    A bin without runs takes the minimum of another; BINS is a prime.
    """
    wide = np.ndarray((len(text),), "<u8", np.concatenate([text, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    runs = z - a - GRAM + 1
    line = np.repeat(np.arange(len(a), dtype=np.int64), runs)
    place = np.arange(len(line)) + np.repeat(a - (np.cumsum(runs) - runs), runs)
    with np.errstate(over="ignore"):
        part = np.repeat(np.tile(_PART, len(a)), np.diff(runs[:, None] * np.arange(PARTS + 1) // PARTS, axis=1).ravel())
        h = ((wide[place] & K.U((1 << 8 * GRAM) - 1)) + part) * K.U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> K.U(29))) * K.U(0xBF58476D1CE4E5B9)
        h ^= h >> K.U(32)
    line *= BINS
    line += (((h >> K.U(32)) * K.U(BINS)) >> K.U(32)).view(np.int64)
    none = np.uint32(2**32 - 1)
    least = np.full(len(a) * BINS, none, np.uint32)
    np.minimum.at(least, line, h.astype(np.uint32))
    least = least.reshape(-1, BINS)
    rows, cols = np.nonzero(least == none)
    if len(rows):
        full = least.copy()
        for k in range(1, BINS):  # each bin looks through the others in an order of its own
            got = least[rows, (cols + k * (1 + cols % (BINS - 1))) % BINS]
            ok = got != none
            full[rows[ok], cols[ok]] = got[ok]
            rows, cols = rows[~ok], cols[~ok]
            if not len(rows):
                break
        least = full
    return least


def _packed(least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sketch: the keys of its blocks (rows x BANDS), and 4 bits of each bin in two words."""
    wide = least.astype(K.U)
    keys = np.stack([K.mix(wide[:, WIDTH * k] << K.U(32) | wide[:, WIDTH * k + 1], k) for k in range(BANDS)], 1)
    bits = (wide >> K.U(7)) & K.U(15)
    low, high = (sum((bits[:, j] << K.U(4 * (j % 16)) for j in range(*r)), np.zeros(len(wide), K.U)) for r in ((0, 16), (16, BINS)))
    return keys, low, high


def agree(a0, a1, b0, b1) -> np.ndarray:
    """Bins in which packed sketches agree."""
    off = np.zeros(np.shape(a0), np.int64)
    for x in (a0 ^ b0, a1 ^ b1):
        x = x | x >> K.U(1)
        off += np.bitwise_count((x | x >> K.U(2)) & K.U(0x1111111111111111))
    return BINS - off


_SCAN = "dk bigint, doc_id bigint, line int, l1 bigint, l2 bigint"


def _lines(texts: pa.Array):
    """The lines of texts in pieces: each line's text and place in it, those that are not blank, their hashes (l1, l2), bytes as normalised from text[a:z], and those that have a sketch."""
    _, off0 = K.utf8(texts)
    for i, j in K.pieces(off0):
        low = [(x or "").lower().encode("utf-8", "surrogatepass") for x in texts.slice(i, j - i).to_pylist()]
        raw = np.frombuffer(b"\n".join(low) + b"\n", np.uint8)
        size = np.array([len(x) + 1 for x in low], np.int64)
        breaks = np.flatnonzero(raw == 10)
        lo = np.concatenate([[0], breaks[:-1] + 1])
        row = np.searchsorted(np.cumsum(size), lo, "right")
        first = np.searchsorted(lo, np.cumsum(size) - size)
        letter, solid = ~_APART[raw], ~K.SPACE[raw]
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        words = np.add.reduceat(start, lo, dtype=np.int32)
        if (raw >= 0xE0).any():
            lone = _unspaced(raw)
            if lone.any():  # a word of such characters counts as many words as it has
                at = np.flatnonzero(start)
                each = np.add.reduceat(lone & letter, at, dtype=np.int32)
                words = words + np.bincount(np.searchsorted(breaks, at), weights=np.maximum(each, 1) - 1, minlength=len(breaks)).astype(np.int32)
        fuzzy = words >= WORDS_FUZZY
        some = np.flatnonzero(np.logical_or.reduceat(solid, lo))
        if not len(some):
            continue
        l1, l2 = np.zeros(len(lo), K.U), np.zeros(len(lo), K.U)
        text, a, z = _flat(raw, letter | _DIGIT[raw], lo, breaks)
        l1[:], l2[:] = _hash2(text, a, z, 21)
        plain = np.flatnonzero(~fuzzy)
        if len(plain):
            mine = np.repeat(~fuzzy, breaks + 1 - lo)
            ends = np.cumsum(breaks[plain] + 1 - lo[plain])
            flat, pa_, pz = _flat(raw[mine], solid[mine], ends - (breaks[plain] + 1 - lo[plain]), ends - 1)
            l1[plain], l2[plain] = _hash2(flat, pa_, pz, 23)
        yield row + i, np.arange(len(lo)) - first[row], some, l1, l2, text, a, z, some[fuzzy[some] & ((z - a)[some] >= BYTES_LEAST)]


def _scan(batches):
    """A row per line that is not blank: its document's key, place and hash."""
    for b in batches:
        for row, line, some, l1, l2, *_ in _lines(b.column("text")):
            at = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([b.column("dk").take(at), b.column("doc_id").take(at), pa.array(line[some].astype(np.int32)), pa.array(K.signed(l1[some])), pa.array(K.signed(l2[some]))], names=["dk", "doc_id", "line", "l1", "l2"])


def _new(l1: np.ndarray, at: np.ndarray, seen: set[int]) -> np.ndarray:
    """Those of the lines `at` whose hash is not in seen, each hash once; it is then."""
    at = at[np.sort(np.unique(l1[at], return_index=True)[1])]
    new = np.array([x not in seen for x in l1[at].tolist()], bool)
    seen.update(l1[at[new]].tolist())
    return at[new]


def normalise(line: str) -> str:
    raw = np.frombuffer(line.lower().encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    text, a, z = _flat(raw, ~_APART[raw] | _DIGIT[raw], np.zeros(1, np.int64), np.array([len(raw) - 1]))
    return text[a[0] : z[0]].tobytes().decode("utf-8", "replace")


def normalised(lines: list[str]) -> pa.Array:
    """`normalise` of lines without line breaks, all at once."""
    raw = np.frombuffer(("\n".join(lines) + "\n").lower().encode("utf-8", "surrogatepass"), np.uint8)
    hi = np.flatnonzero(raw == 10)
    text, a, z = _flat(raw, ~_APART[raw] | _DIGIT[raw], np.append(0, hi[:-1] + 1), hi)
    return _cut(text, a, z)


def _cut(text: np.ndarray, a: np.ndarray, z: np.ndarray) -> pa.Array:
    """text[a:z], which follow each other, as strings."""
    keep = np.cumsum(np.bincount(a, minlength=len(text) + 1) - np.bincount(z, minlength=len(text) + 1))[: len(text)] > 0
    off = np.append(0, np.cumsum(z - a)).astype(np.int32)
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(off.tobytes()), pa.py_buffer(text[keep].tobytes()))


def _marks(ids: DataFrame) -> np.ndarray:
    """MARKS bits, with those of the hash classes of ids set: 1 << 19 rows at most, whatever the number of ids."""
    slot = F.pmod("id", F.lit(MARKS))
    words = ids.select(F.shiftright(slot, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(id, 64) as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MARKS >> 6, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(K.U)


def _texts(marks: np.ndarray):
    """Normalised text of each line that has a sketch and a mark, by its class (id), once a task, and what `_letters` tells of it."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, _, _, l1, _, text, a, z, at in _lines(b.column("text")):
                slot = l1[at] & K.U(MARKS - 1)
                at = _new(l1, at[(marks[(slot >> K.U(6)).view(np.int64)] >> (slot & K.U(63)) & K.U(1)).astype(bool)], seen)
                if len(at):
                    t = _cut(text, a[at], z[at])
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(l1[at])), t, _letters(t)], names=["id", "t", "h"])

    return run


#: Characters of a text, and how often each of a-z and the blank occurs in it, up to 255.
_LETTERS = np.dtype([("n", "<u4"), ("c", "u1", 27)])


def _letters(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts), _LETTERS)
    raw, off = K.utf8(texts)
    for i, j in K.pieces(off):
        code = raw[off[i] : off[j]].astype(np.int64)
        row = np.repeat(np.arange(j - i), np.diff(off[i : j + 1]))
        head = (code & 0xC0) != 0x80  # a character's first byte
        out["n"][i:j] = np.bincount(row[head], minlength=j - i)
        kind = np.where(code == 32, 26, code - 97)
        ours = (kind >= 0) & (kind < 27) & (code < 123)
        each = np.bincount(row[ours] * 27 + kind[ours], minlength=27 * (j - i)).reshape(-1, 27)
        out["c"][i:j] = np.minimum(each, 255)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_LETTERS.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


_ENTRY = np.dtype([("key", "<u4"), ("chars", "<u2"), ("id", "<i8"), ("s0", "<u8"), ("s1", "<u8")])


def _post(buckets: int):
    """The list entries of the sketches of a task's lines, each class once, as one block of bytes for each bucket of lists."""

    def run(batches):
        held, n, seen = [], 0, set()

        def blocks():
            keys, rest = np.concatenate([k for k, _ in held]), np.concatenate([e for _, e in held])
            to = ((keys >> K.U(32)) * K.U(buckets) >> K.U(32)).view(np.int64)
            o = np.argsort(to, axis=None, kind="stable")
            e = rest[o // BANDS]
            e["key"] = keys.ravel()[o].astype(np.uint32)
            cut = np.searchsorted(to.ravel()[o], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([e[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], names=["bucket", "data"])

        for b in batches:
            for _, _, _, l1, _, text, a, z, at in _lines(b.column("text")):
                at = _new(l1, at, seen)
                if not len(at):
                    continue
                e = np.zeros(len(at), _ENTRY)
                e["id"], e["chars"] = K.signed(l1[at]), np.minimum((z - a)[at], 65535)
                keys, e["s0"], e["s1"] = _packed(sketches(text, a[at], z[at]))
                held.append((keys, e))
                n += BANDS * len(at)
                if n >= FLUSH:
                    yield blocks()
                    held, n = [], 0
        if held:
            yield blocks()

    return run


def _fit(chars, x, y):
    """Whether the lengths of rows x and y, x not the longer, are alike; those of 65,535 bytes and more all are."""
    return chars[x] >= SIMILARITY * chars[y] - 1e-9


_LIST = "key bigint, id bigint, chars int, s0 bigint, s1 bigint, partner bigint, score int"


def _lists(table):
    """The entries of one bucket that agree with another of their list, each with the best partner found among those before it in an order that all lists share; score 0 without."""
    bucket = table["bucket"][0].as_py()
    e = np.frombuffer(b"".join(table["data"].to_pylist()), _ENTRY)
    e = e[np.lexsort((e["id"], e["key"].astype(K.U) << K.U(16) | e["chars"]))]
    same = (e["key"][1:] == e["key"][:-1]) & (e["id"][1:] == e["id"][:-1])
    e = e[np.append(True, ~same)] if len(e) else e  # a class that several tasks sent
    key, chars, ids, s0, s1 = e["key"], e["chars"].astype(np.int64), e["id"], e["s0"], e["s1"]
    list_no = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    found, best, partner = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32), np.zeros(len(key), np.int64)
    order, some = K.mix(ids.view(K.U), 41), np.zeros(len(key), bool)  # some: agrees with another at all
    size = np.bincount(list_no)
    open_ = size > 1
    x, gap = np.arange(len(key)), 0
    while len(x):
        gap += 1
        x = x[: np.searchsorted(x, len(key) - gap)]
        y = x + gap
        ok = (list_no[x] == list_no[y]) & _fit(chars, x, y) & open_[list_no[x]]  # sorted by length: a gap that does not fit ends an entry's search
        x = x[ok]
        y = x + gap
        later = order[x] > order[y]
        look = (found[np.where(later, x, y)] < ENOUGH) | ~some[x] | ~some[y]
        a, b, later = x[look], y[look], later[look]
        n = agree(s0[a], s1[a], s0[b], s1[b]).astype(np.int32)
        ok = n >= PASS
        a, b, n, later = a[ok], b[ok], n[ok], later[ok]
        some[a] = some[b] = True
        for m, p, q in ((later, a, b), (~later, b, a)):  # each of them is in here once
            p, q, k = p[m], q[m], n[m]
            found[p] += 1
            better = k > best[p]
            best[p[better]], partner[p[better]] = k[better], ids[q[better]]
        if gap % 16 == 0:
            lone, first = np.bincount(list_no, weights=~some), np.bincount(list_no, weights=found == 0)
            open_ = (lone > 0) | (first > np.maximum(1, size // LEFT))
    k = np.flatnonzero(some)
    return pa.table([pa.array((np.int64(bucket) << 32) + key[k].astype(np.int64)), pa.array(ids[k]), pa.array(chars[k].astype(np.int32)), pa.array(s0[k].view(np.int64)), pa.array(s1[k].view(np.int64)), pa.array(partner[k]), pa.array(best[k])],
                    names=["key", "id", "chars", "s0", "s1", "partner", "score"])


def _runs(batches, names):
    """Columns of whole runs of equal key, one block of many runs after another."""
    tail = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if tail is not None:
            t = pa.concat_tables([tail, t]).combine_chunks()
        key = t["key"].to_numpy()
        if not len(key):
            continue
        other = np.flatnonzero(key != key[-1])
        cut = other[-1] + 1 if len(other) else 0
        tail = t.slice(cut)
        if cut:
            yield [t.slice(0, cut)[c].to_numpy() for c in names]
    if tail is not None and len(tail):
        yield [tail[c].to_numpy() for c in names]


_TRIED = "a bigint, b bigint, crowd bigint"


def _tried(round_: int | None):
    """All pairs of a list that agree and stand in different groups so far; but of a crowd, a list that has over CROWD of them for each entry, only
    one pair for each entry, if a few random places hold one, and the list's key. Without a round no list counts as a crowd."""

    def run(batches):
        for key, ids, chars, s0, s1, comp in _runs(batches, ("key", "id", "chars", "s0", "s1", "c")):
            chars, s0, s1 = chars.astype(np.int64), s0.view(K.U), s1.view(K.U)
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(at, len(key)))
            list_no = np.repeat(np.arange(len(at)), sizes)
            seen, crowd = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            found, x, gap = [np.zeros((2, 0), np.int64)], np.arange(len(key)), 0
            while len(x):
                gap += 1
                x = x[: np.searchsorted(x, len(key) - gap)]
                x = x[(list_no[x] == list_no[x + gap]) & _fit(chars, x, x + gap) & ~crowd[list_no[x]]]
                a = x[comp[x] != comp[x + gap]]
                a = a[agree(s0[a], s1[a], s0[a + gap], s1[a + gap]) >= PASS]
                if len(a):
                    found.append(np.stack([a, a + gap]))
                    if round_ is not None:
                        seen += np.bincount(list_no[a], minlength=len(at))
                        crowd = seen > CROWD * sizes
            pairs = np.concatenate(found, axis=1)
            pairs = pairs[:, ~crowd[list_no[pairs[0]]]]
            pairs = np.unique(np.stack([np.minimum(ids[pairs[0]], ids[pairs[1]]), np.maximum(ids[pairs[0]], ids[pairs[1]])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], names=["a", "b", "crowd"])
            todo = np.flatnonzero(crowd[list_no])
            if not len(todo):
                continue
            start, size, found = np.repeat(at, sizes), np.repeat(sizes, sizes), []
            for k in range(PROBES):
                step = 1 + (K.mix(key[todo].view(K.U), PROBES * round_ + k) % np.maximum(size[todo] - 1, 1).astype(K.U)).astype(np.int64)
                other = start[todo] + (todo - start[todo] + step) % size[todo]
                ok = (comp[todo] != comp[other]) & _fit(chars, np.minimum(todo, other), np.maximum(todo, other))
                ok &= agree(s0[todo], s1[todo], s0[other], s1[other]) >= PASS
                found.append(np.stack([ids[todo[ok]], ids[other[ok]]]))
                todo = todo[~ok]
            pairs, keys = np.concatenate(found, axis=1), key[at[crowd]]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(pairs[0], keys)), pa.array(pairs[1].tolist() + [None] * len(keys), pa.int64()), pa.array(np.append(np.zeros(pairs.shape[1], np.int64), keys))], names=["a", "b", "crowd"])

    return run


def _middles(x: str, y: str) -> tuple[str, str]:
    """x and y without what both begin and end with, the shorter first."""
    n, a, step = min(len(x), len(y)), 0, 64
    while a < n and x[a : a + step] == y[a : a + step]:
        a += step
    a = min(a, n)
    while a < n and x[a] == y[a]:
        a += 1
    x, y = x[a:], y[a:]
    n, z = min(len(x), len(y)), 0
    while z + step <= n and x[len(x) - z - step : len(x) - z] == y[len(y) - z - step : len(y) - z]:
        z += step
    while z < n and x[len(x) - z - 1] == y[len(y) - z - 1]:
        z += 1
    x, y = x[: len(x) - z], y[: len(y) - z]
    return (x, y) if len(x) <= len(y) else (y, x)


def distance(x: str, y: str, most: int) -> int:
    """Edit distance of x and a y that is not shorter, by one machine word of any length; most + 1 where it is above `most`."""
    if not x:
        return min(len(y), most + 1)
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << len(x) - 1
    up, down, score, left = full, 0, len(x), len(y)
    for c in y:  # columns of the distance table as differences of its rows
        eq = at.get(c, 0)
        v = eq | down
        eq |= ((eq & up) + up) ^ up
        h = down | full & ~(eq | up)
        d = up & eq
        left -= 1
        if h & top:
            score += 1
            if score - left > most:
                return most + 1
        elif d & top:
            score -= 1
        h = h << 1 & full | 1
        d = d << 1 & full
        up = d | full & ~(v | h)
        down = h & v
    return min(score, most + 1)


def distances(pairs: list[tuple[str, str]], most: int) -> np.ndarray:
    """Edit distances of pairs (shorter, longer) where they are at most `most`, else something above it; all pairs at once, by 64 rows
    of the distance table in a word, and only the words near its diagonal."""
    order = sorted(range(len(pairs)), key=lambda i: -len(pairs[i][1]))
    m, n = (np.array([len(pairs[i][k]) for i in order], np.int64) for k in (0, 1))
    size, words = len(order), int(-(-m.max() // 64))
    codes = np.frombuffer("".join(pairs[i][0] + pairs[i][1] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, codes = np.unique(codes, return_inverse=True)
    base = np.cumsum(m + n) - (m + n)
    row = np.repeat(np.arange(size), m)
    i = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    equal = np.zeros((words, size * len(alphabet)), K.U)
    np.bitwise_or.at(equal, (i >> 6, row * len(alphabet) + codes[np.repeat(base, m) + i]), K.U(1) << (i & 63).astype(K.U))
    up, down = np.full((words, size), 2**64 - 1, K.U), np.zeros((words, size), K.U)
    active, one, top = size, K.U(1), K.U(63)
    out, rows = np.zeros(size, np.int64), np.arange(size) * len(alphabet)
    for j in range(int(n[0])):
        while n[active - 1] <= j:
            active -= 1
        k = slice(0, active)
        at = rows[k] + codes[base[k] + m[k] + j]
        more, less = np.ones(active, K.U), np.zeros(active, K.U)  # horizontal differences that come in from above
        for w in range(max(0, j - most) >> 6, min(words - 1, (j + most) >> 6) + 1):
            p, q, eq = up[w, k], down[w, k], equal[w][at]
            v = eq | q
            eq = eq | less
            x = (((eq & p) + p) ^ p) | eq
            h, d = q | ~(x | p), p & x
            h, d, more, less = h << one | more, d << one | less, h >> top, d >> top
            up[w, k] = d | ~(v | h)
            down[w, k] = h & v
        over = int(np.searchsorted(-n, -(j + 1), "right"))  # longer ones go on
        end = np.arange(int(np.searchsorted(-n, -(j + 1))), over)
        if len(end):
            bits = np.clip(m[end] - 64 * np.arange(words)[:, None], 0, 64)
            mask = np.where(bits == 64, K.U(2**64 - 1), (one << np.minimum(bits, 63).astype(K.U)) - one)
            out[end] = j + 1 + (np.bitwise_count(up[:, end] & mask).astype(np.int64) - np.bitwise_count(down[:, end] & mask).astype(np.int64)).sum(0)
    back = np.zeros(size, np.int64)
    back[order] = out
    return back


def lacking(pairs: list[tuple[str, str]]) -> np.ndarray:
    """How many runs of RUN characters one text of each pair has beyond the other's, by hash classes, so that some may be missed: an edit brings RUN of them at most."""
    out = np.zeros(len(pairs), np.int64)
    for k in range(0, len(pairs), 512):
        some = pairs[k : k + 512]
        size = np.array([len(t) for pair in some for t in pair], np.int64)
        code = np.frombuffer("".join([t for pair in some for t in pair]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(K.U)
        at = np.repeat(np.arange(2 * len(some)), size)
        whole = np.flatnonzero(np.arange(len(code)) + RUN <= np.cumsum(size)[at])
        h = (code[whole] | code[whole + 1] << K.U(21) | code[whole + 2] << K.U(42)) * K.U(0x9E3779B97F4A7C15) >> K.U(54)
        n = np.bincount((at[whole] << 10) + h.view(np.int64), minlength=2048 * len(some)).reshape(-1, 2, 1024)
        more = n[:, 0] - n[:, 1]
        out[k : k + 512] = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
    return out


def alike(xs: list[str], ys: list[str]) -> np.ndarray:
    """Whether the edit distance of each pair leaves SIMILARITY of the longer text's characters."""
    ok, todo = np.zeros(len(xs), bool), []
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        most = int((1 - SIMILARITY) * max(len(x), len(y)) + 1e-9)
        if abs(len(x) - len(y)) <= most:
            x, y = _middles(x, y)
            if len(y) <= most:
                ok[i] = True
            elif len(y) > WIDE:
                ok[i] = distance(x, y, most) <= most
            elif x:
                todo.append((i, x, y, most))
    todo.sort(key=lambda t: len(t[2]))
    near = lacking([(x, y) for _, x, y, _ in todo]) <= RUN * np.array([t[3] for t in todo])
    todo = [t for t, keep in zip(todo, near.tolist(), strict=True) if keep]
    for k in range(0, len(todo), 2048):
        some = todo[k : k + 2048]
        found = distances([(x, y) for _, x, y, _ in some], max(t[3] for t in some))
        ok[[t[0] for t in some]] = found <= np.array([t[3] for t in some])
    return ok


def _near(batches):
    """The pairs whose lengths and letters do not rule the similarity out: an edit takes away one letter too many at most, so
    the distance is no less than the letters that one text has beyond the other's."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), _LETTERS) for k in ("x", "y"))
        more = x["c"].astype(np.int16) - y["c"]
        least = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
        nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
        most = ((1 - SIMILARITY) * np.maximum(nx, ny) + 1e-9).astype(np.int64)
        m = pa.array((least <= most) & (np.abs(nx - ny) <= most), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(m), b.column("b").filter(m)], names=["a", "b"])


def _verify(batches):
    """The pairs whose edit similarity is high enough."""
    for b in batches:
        m = pa.array(alike(b.column("x").to_pylist(), b.column("y").to_pylist()), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(m), b.column("b").filter(m)], names=["a", "b"])


def _sieved(docs: DataFrame, some: DataFrame, how: str, key: str = "dk") -> DataFrame:
    """The rows of docs whose key (a hash) falls into a class of those in the first column of some (or, anti, does not): at most SIEVE classes are broadcast."""
    classes = some.select(F.pmod(some.columns[0], F.lit(SIEVE)).alias("sieve")).distinct()
    return docs.withColumn("sieve", F.pmod(key, F.lit(SIEVE))).join(F.broadcast(classes), "sieve", how).drop("sieve")


def line_groups(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, classes, part): every line with its document's key dk and class l1, l2; each class with its first occurrence; the group (component) of
    each class (node, its l1) that has a near copy. All three are stored."""
    spark = docs.sparkSession
    lines = store.save(docs.select("dk", "doc_id", "text").mapInArrow(_scan, _SCAN), "lines")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "dk", "line")
    classes = store.save(lines.groupBy("l1", "l2").agg(F.min(order).alias("first"), F.count("*").alias("n")), "classes")
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() * BANDS // BUCKET_ENTRIES + 1)
    # The class id is the first half of its hash; of the vanishingly few classes that share it, the others stand alone.
    lists = store.save(docs.select("text").mapInArrow(_post(buckets), "bucket int, data binary").groupBy("bucket").applyInArrow(_lists, _LIST), "lists")

    # Only classes with a candidate have their texts fetched, and only theirs are shuffled, but for those that share a mark.
    ids = lists.select("id").distinct()
    texts = docs.select("text").mapInArrow(_texts(_marks(ids)), "id bigint, t string, h binary").join(ids, "id", "left_semi").dropDuplicates(["id"])
    texts = store.save(texts, "texts")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = store.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)

        def each(pairs: DataFrame, what: str) -> DataFrame:
            for k, v in (("a", "x"), ("b", "y")):
                pairs = pairs.join(_sieved(texts.select("id", what), pairs.select(k), "left_semi", "id").select(F.col("id").alias(k), F.col(what).alias(v)), k)
            return pairs.select("a", "b", "x", "y")

        # Many pairs fall by their letters alone, so that only the rest meet their texts, and only texts of these are shuffled.
        near = store.save(each(pairs, "h").mapInArrow(_near, "a bigint, b bigint"), "letters")
        out = store.save(each(near, "t").mapInArrow(_verify, "a bigint, b bigint"), "links")
        store.drop(pairs, near)
        return out

    best = lists.where("score > 0").groupBy("id").agg(F.max(F.struct("score", "partner")).alias("m"))
    links = linked(best.select(F.col("id").alias("a"), F.col("m.partner").alias("b")), "near1")
    part = store.save(connected_components(links, store), "part")

    def unjoined(lists: DataFrame, part: DataFrame) -> DataFrame:
        """The entries of lists that hold more than one group."""
        at = lists.drop("partner", "score").join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
        apart = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        return store.save(at.join(apart, "key").select("key", "id", "chars", "s0", "s1", "c"), "apart")

    # All pairs of groups that lists leave apart are verified. Crowds are joined before by rounds of one partner for each class, and take part
    # in the next round again; the last one takes what is left in full.
    todo, k = lists, 0
    while True:
        apart = unjoined(todo, part)
        tried = apart.repartition("key").sortWithinPartitions("key", "chars", "id").mapInArrow(_tried(k if k < ROUNDS else None), _TRIED)
        tried = store.save(tried, "tried")
        one = tried.where("crowd is not null and b is not null").groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(k))).alias("b"))
        new = linked(tried.where("crowd is null").select("a", "b").unionByName(one), "tries")
        crowds = tried.where("b is null").select(F.col("crowd").alias("key")).distinct()
        done = crowds.isEmpty()
        k = k + 1 if done or new.count() * FRUIT >= part.count() else ROUNDS
        was, part = part, store.save(connected_components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new), store), "part")
        todo = lists if done else store.save(lists.join(crowds, "key", "left_semi"), "crowds")
        store.drop(apart, tried, new, was)
        if done:
            break
    store.drop(lists, texts, links)
    return lines, classes, part


def dedup_lines(docs: DataFrame, store: Store) -> DataFrame:
    """The rows of docs with every line removed that repeats an earlier line, exactly or nearly; and n_lines, n_removed.

    The first occurrence, by doc_id (null last), then text hash, then line number, stays. Lines of fewer than WORDS_FUZZY
    words go only where they repeat a line exactly, but for case and blanks. A character of a script without blanks counts
    as a word. Blank lines stay. Null texts stay null with 0 lines; a document of copies alone becomes an empty text. Rows equal
    in doc_id and text get the same result. Other columns stay as they are, whatever their names; an empty
    table gives an empty result. Columns of docs named n_lines or n_removed are replaced.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("dk"), F.struct(*cols).alias("row"))
    lines, classes, part = line_groups(keyed.select("dk", "row.doc_id", "row.text"), store)
    # Classes of one line without a near copy, most of them, take no further part.
    kept = store.save(classes.join(part.withColumnRenamed("node", "l1"), "l1", "left").where("component is not null or n > 1").withColumn("g", F.coalesce("component", "l1")), "kept")
    keep = kept.groupBy("g").agg(F.min("first").alias("keep"), F.sum("n").alias("m")).where("m > 1").drop("m")
    copies = store.save(kept.join(keep, "g").select("l1", "l2", "keep"), "copies")
    gone = _sieved(lines, copies, "left_semi", "l1").join(copies, ["l1", "l2"]).where("dk <> keep.dk or line <> keep.line").groupBy("dk").agg(F.collect_set("line").alias("gone"))  # at most a document's lines
    gone = store.save(gone, "gone")
    store.drop(lines, classes, part, kept, copies)
    parts = F.split(F.col("row.text"), "\n", -1)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    count = F.when(F.col("row.text").isNull(), 0).otherwise(F.length("row.text") - F.length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1)
    done = [*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in cols], count.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed")]
    # Documents that lose no line need not meet the others in the join.
    whole = _sieved(keyed, gone, "left_anti").withColumn("gone", F.lit(None).cast("array<int>"))
    return _sieved(keyed, gone, "left_semi").join(gone, "dk", "left").select(*done).unionByName(whole.select(*done))
