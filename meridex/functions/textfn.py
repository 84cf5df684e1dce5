"""Text functions as pure Column -> Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridex.functions.vocabulary import CLITICS, DIALECT

#: White space as Python's str methods see it; Java's \s is narrower.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ARABIC = r"ء-ي"
_FOLD = ("أإآىئؤةـ", "اااييوه")  # the last character has no partner and goes


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def fold_letters(c: Column) -> Column:
    return F.translate(c, *_FOLD)


def _once(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once, however often body names it: the body is a lambda over an array of one."""
    return F.element_at(F.transform(F.array(c), body), 1)


def dialect_forms() -> dict[str, str]:
    """Every token with a dialect form, as it stands or behind a clitic prefix, and its canonical token; the first rule counts."""
    forms = dict(DIALECT)
    for p in CLITICS:
        for tok, to in DIALECT.items():
            forms.setdefault(p + tok, p + to)
    return forms


def canonical_token(tok: Column) -> Column:
    """Dialect form of a whole token, with or without a clitic prefix; else the token."""
    forms = F.create_map(*[F.lit(x) for kv in dialect_forms().items() for x in kv])
    # every form begins with an Arabic letter: a look at one character spares other tokens the walk through the map
    return F.when(F.substring(tok, 1, 1).between("ء", "ي"), F.coalesce(F.try_element_at(forms, tok), tok)).otherwise(tok)


def normalise(c: Column, boundaries: bool = False) -> Column:
    """Normal form of a text; with boundaries, sentence marks become a `|` token. Null becomes ''."""
    x = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[\u0617-\u061a\u064b-\u0652]", "")
    if boundaries:
        x = F.regexp_replace(x, r"[.!?،؛؟;:,\n\r]+", " | ")
    x = F.regexp_replace(fold_letters(x), r"[،؛؟٪-٭]", " ")
    # the ranges of ASCII stand first: most characters are settled before a property is looked up
    x = F.regexp_replace(x, rf"[^a-zA-Z0-9 \p{{L}}\p{{N}}_{SPACE}؀-ۿ{'|' if boundaries else ''}]", " ")
    x = F.lower(F.trim(F.regexp_replace(x, f"[{SPACE}]+", " ")))

    def canonical(t: Column) -> Column:
        known = F.array_join(F.transform(F.split(t, " "), canonical_token), " ")
        return F.when(t.rlike(f"[{ARABIC}]"), F.trim(F.regexp_replace(known, " +", " "))).otherwise(t)

    return _once(x, canonical)


def fingerprint(c: Column) -> Column:
    """Normal form without digits; blanks left inside stay."""
    return F.trim(F.regexp_replace(normalise(c), r"\p{Nd}+", ""))


def fingerprint_tokens(fp: Column) -> Column:
    """Distinct tokens of a fingerprint."""
    return F.array_distinct(F.filter(F.split(fp, " +"), lambda t: t != ""))


def tokens(c: Column) -> Column:
    """Distinct tokens of the fingerprint of a text."""
    return fingerprint_tokens(fingerprint(c))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two token arrays; two empty ones are alike."""
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def script_ratio(c: Column) -> Column:
    """Share of Arabic among Latin and Arabic letters; 0 without any."""
    some = F.regexp_count(c, F.lit(f"[A-Za-z{ARABIC}]"))
    return F.coalesce(F.when(some > 0, F.regexp_count(c, F.lit(f"[{ARABIC}]")) / some), F.lit(0.0))


def spoken_normalise(c: Column) -> Column:
    """Light normal form of transcribed speech."""
    x = F.translate(strip(F.coalesce(c, F.lit(""))), "أإآة", "اااه")
    return F.regexp_replace(F.regexp_replace(x, f"[{SPACE}]+", " "), "([!؟?.،])\\1+", "$1")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), lambda t: t != ""))


def reject_reason(c: Column, min_chars: int = 4, digits_only: bool = True, min_ratio: float = 0.5) -> Column:
    """Why an input text is refused, or null. Routes differ in which checks they make."""
    s = strip(F.coalesce(c, F.lit("")))
    out = F.when(F.length(s) < min_chars, "too short") if min_chars else F.when(F.lit(False), "")
    if digits_only:
        out = out.when(s.rlike(r"^[\p{Nd}\x{00b2}\x{00b3}\x{00b9}]+$"), "numeric only")
    return out.when(script_ratio(c) < min_ratio, "not Arabic")


def term(text: str) -> str:
    """Normal form of a lexicon term, on the driver: its letters folded, its tokens canonical."""
    folded = text.translate(str.maketrans(_FOLD[0][:7], _FOLD[1]))

    def canonical(t: str) -> str:
        hits = [DIALECT[t]] if t in DIALECT else [p + DIALECT[t[len(p) :]] for p in CLITICS if t.startswith(p) and t[len(p) :] in DIALECT]
        return hits[0] if hits else t

    return " ".join(canonical(t) for t in folded.split())
