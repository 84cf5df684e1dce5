"""Arabic rows derived from `documents`, by hash of doc_id, and SQL that computes their normal forms, matches and labels.

The given tables hold no Arabic letter. Each document gets a sentence of 3 to 10 words, drawn from the vocabulary by md5 of
`doc_id:place`; Spark and SQL make the same ones, so that the rules are held against rows that SQL computes by joins on tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridex.functions import vocabulary as V
from meridex.functions.lexicon import LEXICONS

_TERMS = list(dict.fromkeys(t for v in LEXICONS.values() for t in v))

#: The words of the sentences: terms, some with affixes or marks, dialect forms, negators, words that end a scope, others.
WORDS = [
    *_TERMS, *(V.CLITICS[k % 11] + t for k, t in enumerate(_TERMS) if " " not in t and k % 3 == 0), *(t + V.SUFFIXES[k % 8] for k, t in enumerate(_TERMS) if k % 4 == 0),
    *(t + mark for k, t in enumerate(_TERMS) for mark in ("،", ".", " ؟!")[k % 3] if k % 5 == 0), *V.DIALECT, *("و" + t for t in V.DIALECT), *(2 * V.NEGATORS), *("و" + n for n in V.NEGATORS if n[0] != "و"),
    *(3 * [b for b in V.BREAKERS if b != "|"]), *(6 * [V.OR]), *(4 * [V.ADJACENT]), *(3 * ["تورم", "قيح", "ألم", "وجعني ضرسي", "بارد", "يزول", "المضغ", "نزيف اللثه", "لثتي", "ليلا", "حاد", "خفيف", "أحيانًا", "الفكّ", "منذ 3 أيام", "جـــدا", "ok", "؟"]),
]


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hashed(key: str, of: str = "doc_id") -> Column:
    """A number of 32 bits from `doc_id:key`."""
    return _hash(F.concat(F.col(of).cast("string"), F.lit(":" + key)))


def hashed_sql(key: str, of: str = "doc_id") -> str:
    return f"('0x' || md5({of}::varchar || ':{key}')[1:8])::bigint"


def sentence(doc_id: str = "doc_id") -> Column:
    words = F.array(*[F.lit(w) for w in WORDS])
    word = lambda j: F.element_at(words, (_hash(F.concat(F.col(doc_id).cast("string"), F.lit(":"), j.cast("string"))) % len(WORDS) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), (3 + hashed("n", doc_id) % 8).cast("int")), word), " ")


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]"


SENTENCE = f"(select array_to_string(list_transform(range(1, 4 + {hashed_sql('n')} % 8), lambda j: ({_list(WORDS)})[('0x' || md5(doc_id::varchar || ':' || j)[1:8])::bigint % {len(WORDS)} + 1]), ' '))"

_MARKS = r"[.!?،؛؟;:,\n\r]+"


def _letters(text: str, boundaries: bool) -> str:
    """SQL of the normal form of a text before its tokens are made canonical."""
    x = rf"regexp_replace(trim({text}, e' \n\t\r'), '[\x{{0617}}-\x{{061a}}\x{{064b}}-\x{{0652}}]', '', 'g')"
    x = rf"regexp_replace({x}, '{_MARKS}', ' | ', 'g')" if boundaries else x
    x = rf"regexp_replace(translate({x}, 'أإآىئؤةـ', 'اااييوه'), '[،؛؟٪-٭]', ' ', 'g')"
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\t-\r \x{{0600}}-\x{{06FF}}{'|' if boundaries else ''}]', ' ', 'g')"
    return rf"lower(trim(regexp_replace({x}, '[\t-\r ]+', ' ', 'g')))"


_DIALECT = f"""dia0 as (select unnest({_list(V.DIALECT)}) as tok, unnest({_list(V.DIALECT.values())}) as canon),
cli as (select unnest({_list(V.CLITICS)}) as p, unnest(range(1, {len(V.CLITICS) + 1})) as r),
dia as (select tok, arg_min(canon, r) as canon from (select tok, canon, 0 as r from dia0 union all select p || tok, p || canon, r from dia0, cli) group by tok)"""


def _canonical(name: str, source: str, keys: str, text: str) -> str:
    """SQL of a table (keys, t): the canonical tokens of each row's text."""
    return f"""{name} as (select {keys}, list(coalesce(canon, tok) order by i) as t from (select {keys}, unnest(string_split(x, ' ')) as tok, unnest(range(1, len(string_split(x, ' ')) + 1)) as i
from (select {keys}, {text} as x from {source})) left join dia using (tok) group by {keys})"""


_LEXICON = f"""lex as (select unnest({_list(n for n, ts in LEXICONS.items() for _ in ts)}) as name, unnest({_list(t for ts in LEXICONS.values() for t in ts)}) as raw),
{_canonical('lex1', 'lex', 'name, raw', "translate(raw, 'أإآىئؤة', 'اااييوه')")}, terms as (select distinct name, t as ws, len(t) as n from lex1),
suf as (select unnest({_list(['', *V.SUFFIXES])}) as s), pre as (select p from cli union all select ''),
heads as (select name, ws, n, p || ws[1] || s as head from terms, pre, suf where n = 1 or s = ''),
neg0 as (select distinct unnest({_list(V.NEGATORS)}) as raw), {_canonical('neg1', 'neg0', 'raw', "translate(raw, 'أإآىئؤة', 'اااييوه')")},
neg as (select distinct ws from (select t as ws from neg1 union all select list_prepend('و' || t[1], t[2:]) from neg1 where t[1][1] <> 'و') where ws <> ['{V.ADJACENT}'])"""


def _negated(t: str, i: str) -> str:
    """SQL: whether a term at token i of the list t is negated."""
    return f"""(coalesce({t}[{i} - 1] = '{V.ADJACENT}', false) or exists (select 1 from neg, range(4) k(k) where {i} - k - len(ws) >= 1 and {t}[{i} - k - len(ws):{i} - k - 1] = ws
and not list_has_any({t}[{i} - k:{i} - 1], {_list(V.BREAKERS)}) and (k < 3 or list_contains({t}[{i} - k:{i} - 1], '{V.OR}'))))"""


def rows_sql(text: str = SENTENCE) -> str:
    """SQL of the tables ar (doc_id, text), plain and toks (doc_id, t: canonical tokens without and with boundaries)."""
    return f"""{_DIALECT}, ar as (select doc_id, {text} as text from documents), {_canonical('plain', 'ar', 'doc_id', _letters('text', False))}, {_canonical('toks', 'ar', 'doc_id', _letters('text', True))}"""


def spans_sql(text: str = SENTENCE) -> str:
    """SQL of rows_sql and the table hits (doc_id, lexicon, start, stop, negated)."""
    return f"""{rows_sql(text)}, {_LEXICON},
each as (select doc_id, t, unnest(t) as tok, unnest(range(1, len(t) + 1)) as i from toks),
found as (select doc_id, name, t, i, max(n) as n from each join heads on head = tok and (n = 1 or (t[i + 1:i + n - 2] = ws[2:n - 1] and exists (select 1 from suf where t[i + n - 1] = ws[n] || s))) group by all),
hits as (select doc_id, name as lexicon, (len(array_to_string(t[1:i - 1], ' ')) + (i > 1)::int)::int as start, (len(array_to_string(t[1:i - 1], ' ')) + (i > 1)::int + len(array_to_string(t[i:i + n - 1], ' ')))::int as stop,
{_negated('t', 'i')} as negated from found)"""


def scope_sql() -> str:
    """SQL of rows_sql and the table scope (doc_id, i, negated): whether a term at token i would be negated."""
    return f"{rows_sql()}, {_LEXICON}, each as (select doc_id, t, unnest(range(1, len(t) + 1)) as i from toks), scope as (select doc_id, i, {_negated('t', 'i')} as negated from each)"


def _has(group: str):
    return lambda name: f"list_contains(names, '{group}.{name}')"


def labels_sql(text: str = SENTENCE) -> str:
    """SQL of spans_sql and the table lab (doc_id, names, label, severity, flags, urgent): labels of the rules alone."""
    r, u, flag = _has("rule"), _has("urgency"), _has("flag")
    night, persistent, throbbing, severe = (f"({r('pain')} and {r(k)})" for k in ("night", "persistent", "throbbing", "severe"))
    flags = ", ".join(f"case when {flag(c)} then '{c}' end" for c in V.RED_FLAGS)
    critical = ", ".join(map(_text, V.CRITICAL))
    severity = " ".join(f"when {_text(k)} then '{v}'" for k, v in V.SEVERITY_OF.items())
    return f"""{spans_sql(text)},
named as (select doc_id, array_to_string(t, ' ') as norm, coalesce(ns, []) as names from toks left join (select doc_id, list(distinct lexicon) as ns from hits where not negated group by doc_id) using (doc_id)),
lab0 as (select *, case when norm = '' then '{V.UNCLEAR}'
when {r('pus')} or {r('face_swelling')} or ({r('swelling')} and ({r('pain')} or {severe} or {persistent} or {r('fever')})) then '{V.ABSCESS}'
when ({persistent} and ({night} or {throbbing} or {severe})) or ({night} and {severe}) then '{V.IRREVERSIBLE}'
when {r('stimulus')} and {r('transient')} and not {r('persistent')} then '{V.REVERSIBLE}'
when {r('chewing')} and ({r('pain')} or {r('cavity')} or {r('tooth')}) then '{V.DEEP}'
when {r('bleeding')} and ({r('gum')} or {r('gum_context')}) then '{V.GINGIVITIS}'
when {r('stimulus')} and {r('surface_stimulus')} and not {persistent} and not {night} then '{V.SURFACE}' else '{V.UNCLEAR}' end as label,
list_filter([{flags}, case when {u('fever')} and ({u('swelling')} or {u('pus')}) then 'fever_with_swelling_or_pus' end], lambda x: x is not null) as flags from named),
lab as (select *, case label {severity} end as severity, {urgent_sql('label', f"case label {severity} end", critical)} as urgent from lab0)"""


def urgent_sql(label: str, severity: str, critical: str | None = None) -> str:
    """SQL over names and flags: whether a row of this label and severity is urgent."""
    u = _has("urgency")
    own = critical or ", ".join(map(_text, V.CRITICAL))
    return f"({label} in ({own}) or len(flags) > 0 or {u('pus')} or ({u('swelling')} and {u('pain')}) or ({severity} = 'High' and {u('pain')} and {u('night')} and {u('unrelieved')}))"


def choice_sql(xs: list[str], key: str) -> str:
    return f"({_list(xs)})[{hashed_sql(key)} % {len(xs)} + 1]"


def choice(xs: list[str], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (hashed(key) % len(xs) + 1).cast("int"))
