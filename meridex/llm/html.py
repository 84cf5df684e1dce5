"""Main text of web pages by union-free regular-expression inference.

A page is a stream of tags and texts. Tandem repeats of the stream fold into repeated groups, and the streams
of a host's pages are aligned one after another: what both have stays, what one of them lacks becomes
optional, and texts become slots that note whether they vary. The result is the host's wrapper, a union-free
regular expression over tags, slots, repeated groups `(...)+` and optional parts `?`. Wrappers are built per task over
all of its pages and then aligned with each other per host, so a host's pages never meet in one task.

A text belongs to the main text by where it stands (in an article or main element if its page has text in one, else in
the container with most of the host's varying text) and not in a menu, header, footer, sidebar, notice, advert, form or
comment section. Inside an article, names put an element outside only if they say nothing but that and its shape, as
comment-list or relatedPosts do and side-effects does not; an article element itself goes by the same rule. An article that
opens with a link for a heading beside one of twice its text or more, which does not, is a teaser. Pages of the second kind are matched with
their host's wrapper and the texts of its content slots are joined; texts that match no slot count by their own path.
"""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|([^<]+|<)", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements without content, elements that part blocks, parts of a page that are not its main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
CORE = frozenset(["article", "main", "body", "html"])
OUTSIDE = frozenset("head nav footer aside form button menu dialog label title object audio video canvas map".split())
_OUTSIDE_WORD = r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|menu|nav\w*|breadcrumbs?|sidebar|side|widget|header|masthead|footer|comments?|commentlist|respond|reply|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|toolbar)"
_OUTSIDE_NAME = re.compile(rf"(?:^|[\s_-]){_OUTSIDE_WORD}(?:$|[\s_-])", re.I)
_OUTSIDE_PART = re.compile(rf"{_OUTSIDE_WORD}|teasers?", re.I)
#: Parts of names that tell an element's shape or place, not what it says.
_SHAPE_PART = re.compile(
    r"\d+|area|articles?|aside|bar|block|body|bottom|box|btns?|buttons?|card|col|column|container|content|form|group|holder|icons?|inline|inner|item|items|left|links?|list|main|module|outer|panel|posts?|region|right|row|section|slot|stories|strip|thread|top|unit|wrap|wrapper|zone", re.I)
_PART = re.compile(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+(?![^\W\dA-Z_])|\d+")


def _outside(named: str, core: bool) -> bool:
    """Whether class, id or role put an element outside the main text; in an article, only names that say nothing else but a shape do."""
    if not core:
        return bool(_OUTSIDE_NAME.search(named))
    for word in named.split():
        parts = _PART.findall(word)
        out = [bool(_OUTSIDE_PART.fullmatch(x)) for x in parts]
        if any(out) and all(o or _SHAPE_PART.fullmatch(x) for o, x in zip(out, parts, strict=True)):
            return True
    return False


@lru_cache(maxsize=8192)
def _kind(name: str, attrs: str, core: bool = False) -> str:
    """An open tag's place in paths: its name, with ! where its name, class, id or role put it outside the main text.

    core: whether it stands in an article or main element. Main, body and html are judged by no class, id or role, an article as if it stood in one.
    """
    named = " ".join(v for m in _NAMED.finditer(attrs) for v in m.groups()[1:] if v) if "=" in attrs and (name not in CORE or name == "article") else ""
    return name + ("!" if name in OUTSIDE or (named and _outside(named, core or name == "article")) else "")


def parse(html: str) -> tuple[list[str], list[tuple[str, str, int, int]]]:
    """(stream, texts): tags and # for each text; for each text its path, its characters, its block's number and its outermost article's (0: none)."""
    stream, texts, stack, block, article = [], [], [], 0, 0
    for m in _TOKEN.finditer(html):
        text, name, k = m.group(8), m.group(3), 2
        if name is None and text is None and m.group(6) is not None:
            name, k = m.group(6), 5  # a quote that nothing closes ends with its tag
        if text is not None:
            if text.strip():
                stream.append("#")
            full = bool(text.strip())
            texts.append(("/".join(stack), text if full else " ", block if full else -1, article if "article" in stack else 0))
        elif name is not None:
            name = name.lower()
            if name == "br":
                texts.append(("", " ", -1, 0))
            elif name in BLOCK:
                block += 1
            if m.group(k):
                base = [x.rstrip("!") for x in stack]
                if name in base:
                    del stack[len(base) - 1 - base[::-1].index(name) :]
                stream.append(f"</{name}>")
            else:
                while stack and name in CLOSED_BY.get(_open_block(stack), ()):
                    _close(stack)
                if name not in VOID:
                    attrs = m.group(k + 2) or ""
                    core = "article" in stack or "main" in stack
                    article += name == "article" and "article" not in stack
                    stack.append(_kind(name, attrs, core) if len(attrs) < 512 else _kind.__wrapped__(name, attrs, core))
                stream.append(f"<{stack[-1] if name not in VOID else name}>")
    return stream, texts


def _open_block(stack: list[str]) -> str:
    """The innermost open element, seen through inline ones."""
    for x in reversed(stack):
        if x.rstrip("!") in BLOCK:
            return x.rstrip("!")
    return ""


def _close(stack: list[str]) -> None:
    while stack and stack.pop().rstrip("!") not in BLOCK:
        pass


def fold(stream: list[str]) -> list[tuple]:
    """Items (key, leaves): tandem repeats become ('+', keys); leaves has, for each # of a key, the numbers of its texts."""
    n, items = 0, []
    for x in stream:
        items.append((x, [[n]] if x == "#" else []))
        n += x == "#"
    for width in range(1, 13):
        names = [k for k, _ in items]
        i, out = 0, []
        while i < len(items):
            # the first names tell most groups apart
            if i + 2 * width > len(items) or names[i] != names[i + width] or names[i : i + width] != names[i + width : i + 2 * width] or (width == 1 and names[i][0] == "+"):
                out.append(items[i])
                i += 1
                continue
            keys, leaves, j = names[i : i + width], [list(z) for _, ls in items[i : i + width] for z in ls], i + width
            while names[j : j + width] == keys:
                for a, b in zip(leaves, (z for _, ls in items[j : j + width] for z in ls), strict=True):
                    a.extend(b)
                j += width
            out.append((("+", tuple(keys)), leaves))
            i = j
        items = out
    return items


def _teasers(texts: list[tuple[str, str, int, int]]) -> set[int]:
    """The articles of a page that open with a link alone and have half the text at most of one that does not."""
    size: dict[int, int] = {}
    head: dict[int, int] = {}
    linked: dict[int, bool] = {}
    for path, text, block, article in texts:
        if block >= 0 and article and "!" not in path:
            size[article] = size.get(article, 0) + len(text.strip())
            if head.setdefault(article, block) == block:
                linked[article] = linked.get(article, True) and "a" in path.split("/")
    most = max((n for a, n in size.items() if not linked[a]), default=0)
    return {a for a, n in size.items() if linked[a] and 2 * n <= most}


def _core(path: str) -> bool:
    """Whether a text's path is in an article or main element and not outside the main text."""
    return "!" not in path and not {"article", "main"}.isdisjoint(path.split("/"))


class Wrapper:
    """parts: [key, optional, slots]; a slot: [path, pages, characters, its one text or None where it varies]."""

    def __init__(self, parts: list | None = None, pages: int = 0):
        self.parts, self.pages = parts or [], pages

    @classmethod
    def of_page(cls, html: str) -> Wrapper:
        stream, texts = parse(html)
        real = [t for t in texts if t[2] >= 0]
        parts = []
        for key, leaves in fold(stream):
            slots = []
            for at in leaves:
                said = {" ".join(real[i][1].split()) for i in at}
                slots.append([real[at[0]][0], 1, sum(len(real[i][1]) for i in at), said.pop() if len(said) == 1 else None])
            parts.append([key, False, slots])
        return cls(parts, 1)

    def align(self, other: Wrapper) -> None:
        """Takes another wrapper of the same host in."""
        if not self.pages:
            self.parts, self.pages = other.parts, other.pages
            return
        mine, new = [p[0] for p in self.parts], [p[0] for p in other.parts]
        out = []
        for op, a, b, c, d in _opcodes(tuple(mine), tuple(new)):
            if op == "equal":
                for p, q in zip(self.parts[a:b], other.parts[c:d], strict=True):
                    slots = [[s[0], s[1] + t[1], s[2] + t[2], s[3] if s[3] == t[3] else None] for s, t in zip(p[2], q[2], strict=True)]
                    out.append([p[0], p[1] or q[1], slots])
            else:
                out += [[p[0], True, p[2]] for p in (*self.parts[a:b], *other.parts[c:d])]
        self.parts, self.pages = out, self.pages + other.pages

    def expression(self) -> str:
        """The wrapper as a union-free regular expression."""
        say = lambda k: k if isinstance(k, str) else "(" + "".join(map(say, k[1])) + ")+"
        return "".join(f"({say(k)})?" if o else say(k) for k, o, _ in self.parts)

    def content(self) -> tuple[set[tuple[int, int]], tuple]:
        """For pages without text in an article or main element: (part, slot) of the main text, and the path of its container."""
        slots = [(i, j, s) for i, p in enumerate(self.parts) for j, s in enumerate(p[2])]
        # a slot of fewer than three pages may vary, whatever it says on these
        varying = [(i, j, s) for i, j, s in slots if "!" not in s[0] and not _core(s[0]) and (s[3] is None or s[1] < 3)]
        total, by = sum(s[2] for *_, s in varying), {}
        for *_, s in varying:
            path = s[0].split("/")
            for k in range(len(path) + 1):
                by[tuple(path[:k])] = by.get(tuple(path[:k]), 0) + s[2]
        best = max((p for p, c in by.items() if c >= 0.6 * total and not (p and p[-1] in ("p", "b", "i", "a", "span", "em", "strong"))), key=len, default=())
        return {(i, j) for i, j, s in varying if tuple(s[0].split("/"))[: len(best)] == best}, best

    def dumps(self) -> str:
        return json.dumps([self.pages, self.parts])

    @classmethod
    def loads(cls, x: str) -> Wrapper:
        pages, parts = json.loads(x)
        tup = lambda k: k if isinstance(k, str) else ("+", tuple(map(tup, k[1])))
        return cls([[tup(k), o, s] for k, o, s in parts], pages)


@lru_cache(maxsize=4096)
def _opcodes(a: tuple, b: tuple) -> list:
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


@lru_cache(maxsize=512)
def _known(dumped: str) -> tuple[tuple, list, frozenset, tuple]:
    w = Wrapper.loads(dumped)
    content, best = w.content()
    return tuple(p[0] for p in w.parts), [[s[0] for s in p[2]] for p in w.parts], frozenset(content), best


def extract(html: str, dumped: str) -> str:
    """The main text of a page by its host's wrapper; a text that the wrapper does not match counts by its own path."""
    stream, texts = parse(html)
    paths = [t[0] for t in texts if t[2] >= 0]
    teasers = _teasers(texts)
    articles = [t[3] for t in texts if t[2] >= 0]
    wanted = {k for k, path in enumerate(paths) if _core(path) and articles[k] not in teasers}
    if not wanted:
        items = fold(stream)
        keys, places, content, best = _known(dumped)
        matched: set[int] = set()
        for op, a, b, c, d in _opcodes(keys, tuple(k for k, _ in items)):
            if op == "equal":
                for i, k in zip(range(a, b), range(c, d), strict=True):
                    for j, at in enumerate(items[k][1]):
                        here = [x for x in at if paths[x] == places[i][j]]  # tags of two templates may match in part
                        matched.update(here)
                        if (i, j) in content:
                            wanted.update(here)
        wanted |= {k for k, path in enumerate(paths) if k not in matched and "!" not in path and tuple(path.split("/"))[: len(best)] == best}
    blocks: dict[int, list[str]] = {}
    n, last = -1, None
    for _, text, block, _ in texts:
        if block < 0:
            if last is not None:
                blocks[last].append(" ")
            continue
        n += 1
        last = block if n in wanted else None
        if last is not None:
            blocks.setdefault(block, []).append(text)
    said = (" ".join(unescape("".join(x)).split()) for _, x in sorted(blocks.items()))
    return "\n".join(x for x in said if x)


def _infer(batches):
    found: dict[str, Wrapper] = {}
    for b in batches:
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            found.setdefault(host, Wrapper()).align(Wrapper.of_page(html or ""))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([w.dumps() for w in found.values()], pa.string())], names=["host", "wrapper"])


def _join(table):
    whole = Wrapper()
    for x in sorted(table["wrapper"].to_pylist(), key=lambda x: (-len(x), x)):
        whole.align(Wrapper.loads(x))
    return pa.table([pa.array([table["host"][0].as_py()]), pa.array([whole.dumps()])], names=["host", "wrapper"])


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: the wrapper of each host's pages, all of them aligned."""
    own = pages.select(_host().alias("host"), "html").mapInArrow(_infer, "host string, wrapper string")
    return own.groupBy("host").applyInArrow(_join, "host string, wrapper string")


def _extract(batches):
    for b in batches:
        text = [extract(h or "", w) for h, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row.

    A null or empty html has an empty text. Pages without a host in their url form one host. Repeated rows each get
    a row; more columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    return rows.join(wrappers(pages), "host").select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
