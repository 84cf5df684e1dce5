"""Lexicon matching with a bounded scope of negation, as native expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridex.functions import vocabulary as V
from meridex.functions.textfn import term

_AR = "ء-ي"
_CUT = "\u0001"  # never part of a normal form


def negators() -> list[str]:
    """All negators in normal form, each also with a leading conjunction."""
    out: list[str] = []
    for raw in V.NEGATORS:
        n = term(raw)
        out += [x for x in (n, n if n.startswith("و") else "و" + n) if x not in out]
    return list(dict.fromkeys(out))


def _any(options: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(x).replace("\\ ", r"\s+") for x in options) + ")"


def term_pattern(terms: Iterable[str]) -> str:
    """Zero-width pattern: a place where one of the terms starts, as whole words with optional affixes."""
    own = sorted({term(t) for t in terms}, key=lambda t: (-len(t), t))
    return f"(?<![{_AR}])(?=(?:{'|'.join(V.CLITICS)})?(?:{'|'.join(map(re.escape, own))})(?:{'|'.join(V.SUFFIXES)})?(?![{_AR}]))"


def _negated_pattern() -> str:
    """Matches the text before a term that stands in the scope of a negator."""
    wide = _any(sorted((n for n in negators() if n != V.ADJACENT), key=len, reverse=True))
    tok = rf"(?!{_any(V.BREAKERS)}(?!\S))\S+"
    near = rf"{wide}(?:\s+{tok}){{0,2}}"
    far = rf"{wide}(?=(?:\s+\S+){{0,2}}\s+{V.OR}(?!\S))(?:\s+{tok}){{3}}"
    return rf"(?<!\S)(?:{near}|{far}|{V.ADJACENT})\s*$"


NEGATED = _negated_pattern()


def is_negated(before: Column) -> Column:
    """Whether a term that follows the text `before` is negated."""
    return before.rlike(NEGATED)


def has_any(c: Column, terms: Iterable[str], respect_negation: bool = True) -> Column:
    """Whether some term occurs in the normal form c, at some place where it is not negated."""
    terms = list(terms)
    pattern = term_pattern(terms)
    found = c.rlike(pattern)
    if all(re.search(f"[{_AR}]", term(t)) for t in terms):
        found = c.rlike(f"[{_AR}]") & found  # a text without Arabic letters holds none of them, which is cheap to see
    if not respect_negation:
        return F.coalesce(found, F.lit(False))
    pieces = F.split(F.regexp_replace(c, pattern, _CUT), _CUT, -1)
    free = F.exists(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: ~is_negated(F.array_join(F.slice(pieces, 1, i), "")))
    return F.coalesce(F.when(found, free), F.lit(False))
