"""Queries of the library: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridex import derived as D
from meridex.functions import lexicon, rules, textfn, vector
from meridex.functions import metrics as M
from meridex.functions import vocabulary as V
from meridex.functions.match import is_negated
from meridex.operators import dedup, simjoin
from meridex.operators.order import seeded_sql
from meridex.session import Store
from meridex.sources import io, remote

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "source", (F.col("doc_id") % 2).alias("split"))


# --- text functions -------------------------------------------------------------------------------------------------
# No letter of the driver's tables is Arabic, so folding and the dialect map change nothing there; derived rows cover them.
_NORM = r"lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_\t-\r \x{0600}-\x{06FF}]', ' ', 'g'), '[\t-\r ]+', ' ', 'g')))"
_FP = rf"trim(regexp_replace({_NORM}, '\p{{Nd}}+', '', 'g'))"
_TOKS = f"list_distinct(list_filter(string_split({_FP}, ' '), lambda x: x <> ''))"


@query(f"select doc_id, {_NORM} as norm from documents")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textfn.normalise(F.col("text")).alias("norm"))


@query(rf"select doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[.!?;:,\n\r]+', ' | ', 'g'), '[^\p{{L}}\p{{N}}_\t-\r |\x{{0600}}-\x{{06FF}}]', ' ', 'g'), '[\t-\r ]+', ' ', 'g'))) as norm from documents")
def text_normalise_boundaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textfn.normalise(F.col("text"), boundaries=True).alias("norm"))


@query(f"select doc_id, {_FP} as fp from documents")
def text_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textfn.fingerprint(F.col("text")).alias("fp"))


@query(f"select doc_id, len({_TOKS})::bigint as n_tokens, array_to_string(list_sort({_TOKS}), ' ') as toks from documents")
def text_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", textfn.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("toks"))


@query(f"""with t as (select doc_id, {_TOKS} as a from documents)
select x.doc_id, round(case when len(x.a) + len(y.a) = 0 then 1.0 else len(list_intersect(x.a, y.a))::double / len(list_distinct(list_concat(x.a, y.a))) end, 9) as sim
from t x join t y on y.doc_id = x.doc_id + 1""")
def jaccard(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", textfn.tokens(F.col("text")).alias("a"))
    u = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return t.join(u, "doc_id").select("doc_id", F.round(textfn.jaccard(F.col("a"), F.col("b")), 9).alias("sim"))


#: Texts of several scripts: a sentence, the text, its beginning with a sentence, digits, a few letters.
_MIXED = f"(select doc_id, case doc_id % 5 when 0 then {D.SENTENCE} when 1 then text when 2 then left(text, 40) || {D.SENTENCE} when 3 then ' ' || doc_id * 1000 else left(text, 3) end as text from documents)"


def _mixed(spark, sf_dir) -> DataFrame:
    kind, t = F.col("doc_id") % 5, F.col("text")
    text = F.when(kind == 0, D.sentence()).when(kind == 1, t).when(kind == 2, F.concat(F.left(t, F.lit(40)), D.sentence())).when(kind == 3, F.concat(F.lit(" "), (F.col("doc_id") * 1000).cast("string"))).otherwise(F.left(t, F.lit(3)))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_RATIO = r"""case when len(regexp_extract_all(text, '[A-Za-z\x{0621}-\x{064A}]')) = 0 then 0.0::double else len(regexp_extract_all(text, '[\x{0621}-\x{064A}]'))::double / len(regexp_extract_all(text, '[A-Za-z\x{0621}-\x{064A}]')) end"""


@query(f"select doc_id, round({_RATIO}, 9) as ratio from {_MIXED}")
def script_ratio(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", F.round(textfn.script_ratio(F.col("text")), 9).alias("ratio"))


@query(r"select conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> ''))::bigint as words from conversations")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", textfn.word_count(F.col("text")).cast("bigint").alias("words"))


@query(rf"""select doc_id, case when len(trim(coalesce(text, ''), e' \n\t\r')) < 4 then 'too short' when regexp_full_match(trim(text, e' \n\t\r'), '[0-9]+') then 'numeric only' when {_RATIO} < 0.5 then 'not Arabic' end as reason from {_MIXED}""")
def input_validation(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", textfn.reject_reason(F.col("text")).alias("reason"))


@query(r"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(text, ''), e' \n\t\r'), '[\t-\r ]+', ' ', 'g'), '!!+', '!', 'g'), '\?\?+', '?', 'g'), '\.\.+', '.', 'g'), '،،+', '،', 'g') as spoken from conversations""")
def spoken_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", textfn.spoken_normalise(F.col("text")).alias("spoken"))


# --- rules: sentences derived from documents, labelled in SQL by joins on tokens ----------------------------------------------
def _sentences(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", D.sentence().alias("text"))


@query(f"with {D.rows_sql()} select doc_id, trim(regexp_replace(array_to_string(p.t, ' '), ' +', ' ', 'g')) as norm, array_to_string(b.t, ' ') as norm_boundaries from plain p join toks b using (doc_id)")
def text_normalise_arabic(spark, sf_dir):
    t = F.col("text")
    return _sentences(spark, sf_dir).select("doc_id", textfn.normalise(t).alias("norm"), textfn.normalise(t, True).alias("norm_boundaries"))


@query(f"with {D.spans_sql()} select doc_id, lexicon, start, stop, negated from hits")
def lexicon_match(spark, sf_dir):
    hits = _sentences(spark, sf_dir).select("doc_id", F.explode(lexicon.spans(textfn.normalise(F.col("text"), True))).alias("s"))
    return hits.select("doc_id", "s.lexicon", "s.start", F.col("s.end").alias("stop"), "s.negated")


@query(f"with {D.scope_sql()} select doc_id, i, negated from scope")
def negation_scope(spark, sf_dir):
    t = _sentences(spark, sf_dir).select("doc_id", F.split(textfn.normalise(F.col("text"), True), " ").alias("t"))
    each = t.select("doc_id", "t", F.posexplode("t").alias("p", "tok"))
    before = F.concat(F.array_join(F.slice("t", F.lit(1), F.col("p")), " "), F.lit(" "))
    return each.select("doc_id", (F.col("p") + 1).cast("bigint").alias("i"), is_negated(before).alias("negated"))


@query(f"with {D.labels_sql()} select doc_id, label, case when urgent then 'Urgent' else 'Non-Urgent' end as urgency from lab")
def rule_classify(spark, sf_dir):
    return rules.rule_engine(_sentences(spark, sf_dir)).select("doc_id", "label", "urgency")


@query(f"with {D.labels_sql()} select doc_id, case when urgent then 'High' else severity end as severity from lab")
def final_severity(spark, sf_dir):
    return rules.rule_engine(_sentences(spark, sf_dir)).select("doc_id", "severity")


@query(f"with {D.labels_sql()} select doc_id, array_to_string(flags, ';') as flags from lab")
def red_flags(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", F.array_join(rules.red_flags(textfn.normalise(F.col("text"), True)), ";").alias("flags"))


_LABEL, _SEVERITY = D.choice_sql(V.LABELS, "label"), D.choice_sql(["High", "Moderate", "Low"], "severity")


@query(f"with {D.labels_sql()} select doc_id, case when {D.urgent_sql(_LABEL, _SEVERITY)} then 'Urgent' else 'Non-Urgent' end as urgency from lab")
def urgency(spark, sf_dir):
    t = _sentences(spark, sf_dir).withColumn("n", textfn.normalise(F.col("text"), True))  # labels and severities of any kind: the rules give night pain no chance
    return t.select("doc_id", rules.urgency(D.choice(V.LABELS, "label"), D.choice(["High", "Moderate", "Low"], "severity"), F.col("n")).alias("urgency"))


@query(f"with {D.labels_sql()} select doc_id, label, case when urgent then 'Urgent' else 'Non-Urgent' end as urgency, len(flags)::bigint as flags from lab")
def triage_documents(spark, sf_dir):
    # whole texts and their sentences behind a boundary; SQL sees the sentences, as no text has a letter of the lexicons
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" . "), D.sentence())
    r = rules.rule_engine(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")))
    return r.select("doc_id", "label", "urgency", F.size("red_flags").cast("bigint").alias("flags"))


@query(f"select 'ok' as status, true as model_loaded, '{V.MODEL_VERSION}' as model_version, count(*) as prototypes from embeddings")
def health(spark, sf_dir):
    return rules.health(spark).crossJoin(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("prototypes")))  # a row each


# The encoder's say is derived too: a label, a score in steps of 0.001, and in two of three rows a second label.
_SAID = f"""said as (select *, {D.choice_sql(V.LABELS, 'model')} as model, {D.hashed_sql('score')} % 1000 / 1000.0::double as score,
case when {D.hashed_sql('second')} % 3 > 0 then {D.choice_sql(V.LABELS, 'runner')} end as second from lab),
chosen as (select *, case when label in ('{V.CRITICAL[0]}', '{V.CRITICAL[1]}') or model = '{V.UNCLEAR}' then label when label = '{V.UNCLEAR}'
{' '.join(f"or (label = '{k}' and model in ({', '.join(chr(39) + x + chr(39) for x in v)}))" for k, v in V.SAFE_UPGRADES.items() if v and k != V.UNCLEAR)} then model else label end as final,
least(0.9, case when model = '{V.UNCLEAR}' then 0.5 else score end) as conf from said),
judged as (select *, {D.urgent_sql('final', 'severity')} as alarm from chosen),
result as (select *, case when alarm then 'High' else case final {' '.join(f"when '{k}' then '{v}'" for k, v in V.SEVERITY_OF.items())} end end as final_severity from judged)"""


def _analysed(spark, sf_dir) -> DataFrame:
    second = F.when(D.hashed("second") % 3 > 0, D.choice(V.LABELS, "runner"))
    said = F.struct(D.choice(V.LABELS, "model").alias("label"), (D.hashed("score") % 1000 / 1000).alias("score"), second.alias("second_label"), F.when(second.isNotNull(), F.lit(0.25)).alias("second_score"))
    return rules.analyse(_sentences(spark, sf_dir).withColumn("suggestion", said))


@query(f"""with {D.labels_sql()}, {_SAID}
select r.doc_id, array_to_string(p.t, ' ') as clean_text, label as rule_diagnosis, final as diagnosis, model as arabert_diagnosis, second as arabert_second, final_severity as severity, lower(final_severity) as severity_level,
case when alarm then 'Urgent' else 'Non-Urgent' end as urgency, array_to_string(flags, ';') as flags, round(conf, 6) as confidence, case when conf >= 0.75 then 'high' when conf >= 0.5 then 'medium' else 'low' end as confidence_level,
final || coalesce(';' || second, '') as suspected, len(list_filter(p.t, lambda x: x <> ''))::int as tokens_length, '{V.MODEL_VERSION}' as model_version from result r join plain p using (doc_id)""")
def analyse_pipeline(spark, sf_dir):
    r = _analysed(spark, sf_dir)
    return r.select("doc_id", "clean_text", "rule_diagnosis", "diagnosis", "arabert_diagnosis", "arabert_second", "severity", "severity_level", "urgency", F.array_join("red_flags", ";").alias("flags"),
                    F.round("confidence", 6).alias("confidence"), "confidence_level", F.array_join(F.transform("suspected_conditions", lambda s: s["label"]), ";").alias("suspected"),
                    F.col("metadata.tokens_length").alias("tokens_length"), "model_version")


@query(f"""with {D.labels_sql()}, {_SAID} select doc_id, case when alarm then '{V.EXPLAIN_URGENT}' when final_severity = 'Moderate' then '{V.EXPLAIN_MODERATE}' when final_severity = 'Low' then '{V.EXPLAIN_LOW}' else '{V.EXPLAIN_ELSE}' end as said from result""")
def patient_explanation(spark, sf_dir):
    return _analysed(spark, sf_dir).select("doc_id", F.col("patient_explanation").alias("said"))


# --- vectors: prototypes are the three vectors of least vec_id of each label ------------------------------------------------
_CENTROIDS = """ranked as (select *, row_number() over (partition by label order by vec_id) as k from embeddings),
dims as (select label, vec_id, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as x from ranked where k <= 3),
norms as (select vec_id, sqrt(sum(x * x)) as n from dims group by vec_id),
means as (select label, pos, avg(x / n) as x from dims join norms using (vec_id) group by all),
lens as (select label, sqrt(sum(x * x)) as n from means group by label),
cent as (select label, list(x / n order by pos) as c from means join lens using (label) group by label)"""


def _protos(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    firsts = e.select("label", "vec_id").withColumn("_place", place).where("_place <= 3").select("label", "vec_id")  # limited before the shuffle
    return e.join(firsts, ["label", "vec_id"]).select("label", "embedding")


@query(f"with {_CENTROIDS} select label, unnest(range(len(c))) as pos, round(unnest(c), 6) as x from cent")
def prototype_centroid(spark, sf_dir):
    c = vector.centroids(_protos(spark, sf_dir))
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


_SEQUENCES = """seq as (select case when vec_id % 5 = 0 then 's' || (vec_id // 100) else 'l' || (vec_id // 500) end as seq, vec_id % 500 as pos, (vec_id % 7 <> 0 and vec_id // 100 % 4 <> 1)::int as mask, embedding from embeddings)"""


@query(f"""with {_SEQUENCES}, d as (select seq, mask, unnest(range(len(embedding))) as dim, unnest(embedding)::double as x from seq where pos < 256),
m as (select seq, dim, sum(x * mask) / greatest(sum(mask), 1e-9) as x from d group by all), n as (select seq, greatest(sqrt(sum(x * x)), 1e-12) as n from m group by seq)
select seq, dim, round(x / n, 6) + 0.0 as x from m join n using (seq)""")
def encode_pooled(spark, sf_dir):
    """Vectors as the token vectors of sequences of up to 400 tokens, some of them masked, some sequences wholly."""
    e = table(spark, sf_dir, "embeddings")
    seq = F.expr("case when vec_id % 5 = 0 then 's' || cast(vec_id div 100 as string) else 'l' || cast(vec_id div 500 as string) end")
    t = e.select(seq.alias("seq"), (F.col("vec_id") % 500).alias("pos"), F.expr("cast(vec_id % 7 <> 0 and vec_id div 100 % 4 <> 1 as int)").alias("mask"), "embedding")
    p = vector.pool_tokens(t, "seq")
    return p.select("seq", F.posexplode("embedding").alias("dim", "x")).select("seq", F.col("dim").cast("bigint").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


def _suggested(spark, sf_dir, min_score=0.2, min_margin=0.02) -> DataFrame:
    cents = [(r.label, list(r.centroid)) for r in vector.centroids(_protos(spark, sf_dir)).orderBy("label").collect()]  # a row per label
    return vector.suggest(table(spark, sf_dir, "embeddings"), cents, min_score=min_score, min_margin=min_margin, unclear=-1)


def _suggest_sql(score: float, margin: float) -> str:
    return f"""{_CENTROIDS}, scored as (select e.vec_id, e.label as gold, c.label, greatest(-1, least(1, list_dot_product(e.embedding::double[], c.c))) as s from embeddings e, cent c),
tops as (select *, row_number() over (partition by vec_id order by s desc, label) as k from scored),
sugg as (select a.vec_id, a.gold, case when a.s < {score} or a.s - b.s < {margin} then -1 else a.label end as pred, a.s as score, b.label as second_label, b.s as second_score
from tops a join tops b using (vec_id) where a.k = 1 and b.k = 2)"""


_SUGG = _suggest_sql(0.2, 0.02)


@query(f"with {_SUGG} select vec_id, pred, round(score, 6) as score, second_label, round(second_score, 6) as second_score from sugg")
def prototype_top2(spark, sf_dir):
    s = _suggested(spark, sf_dir)
    return s.select("vec_id", F.col("suggestion.label").alias("pred"), F.round("suggestion.score", 6).alias("score"), F.col("suggestion.second_label").alias("second_label"), F.round("suggestion.second_score", 6).alias("second_score"))


@query(f"with {_suggest_sql(V.MIN_SCORE, V.MIN_MARGIN)} select vec_id, pred from sugg")
def prototype_default_thresholds(spark, sf_dir):
    return _suggested(spark, sf_dir, V.MIN_SCORE, V.MIN_MARGIN).select("vec_id", F.col("suggestion.label").alias("pred"))


@query(f"""with {_SUGG} select vec_id, case when gold in (0, 1) or pred = -1 then gold when gold = 9 or (gold = 2 and pred in (3, 4)) or (gold = 3 and pred in (4, 5)) then pred else gold end as final from sugg""")
def hybrid_decision(spark, sf_dir):
    s = _suggested(spark, sf_dir)
    d = rules.hybrid_decision(F.col("label"), F.col("suggestion.label"), {2: [3, 4], 3: [4, 5]}, critical=[0, 1], unclear=9)
    d = F.when(F.col("suggestion.label") == -1, F.col("label")).otherwise(d)
    return s.select("vec_id", d.alias("final"))


@query(f"""with {_SUGG}, c as (select vec_id, least(0.9, greatest(0.0, case when pred = -1 then 0.5 else score * 2 end)) as c from sugg)
select vec_id, round(c, 6) as confidence, case when c >= 0.75 then 'high' when c >= 0.5 then 'medium' else 'low' end as level from c""")
def confidence_bucket(spark, sf_dir):
    c = rules.confidence(F.col("suggestion.label"), F.col("suggestion.score") * 2, unclear=-1)
    return _suggested(spark, sf_dir).withColumn("c", c).select("vec_id", F.round("c", 6).alias("confidence"), rules.confidence_level(F.col("c")).alias("level"))


# --- similarity, duplicates, splits -------------------------------------------------------------------------------------
_T = f"t as (select doc_id as id, {_FP} as fp, {_TOKS} as a, source, doc_id % 2 as split from documents)"
_PAIRS = f"""{_T}, e as (select id, len(a) as n, unnest(a) as tok from t),
near as (select x.id as a, y.id as b, count(*)::double / (x.n + y.n - count(*)) as score from e x join e y on x.tok = y.tok and x.id < y.id group by x.id, y.id, x.n, y.n having count(*)::double / (x.n + y.n - count(*)) >= 0.9)"""
_BOTH = f"""{_PAIRS}, sym as (select a, b from near union all select b, a from near), reach as (select distinct a as id, a as c from sym union select s.b, r.c from reach r join sym s on s.a = r.id),
comp as (select t.id, coalesce(min(c), t.id) as component from t left join reach using (id) group by t.id)"""


@query(f"with {_T} select fp, array_to_string(list_sort(list(id)), ',') as ids from t where fp <> '' group by fp having count(*) > 1")
def exact_dups(spark, sf_dir):
    return simjoin.exact_duplicates(_docs(spark, sf_dir)).select("fp", F.array_join(F.transform("row_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"with {_PAIRS} select a, b, round(score, 9) as score from near")
def near_dup_pairs(spark, sf_dir):
    return simjoin.near_duplicate_pairs(_docs(spark, sf_dir)).select("a", "b", F.round("score", 9).alias("score"))


@query(f"""with {_PAIRS} select 'exact' as kind, fp as key, array_to_string(list_sort(list(id)), ',') as ids from t where fp <> '' group by fp having count(distinct split) > 1
union all select 'near', '', a || ',' || b from near where a % 2 <> b % 2 union all select 'group', source, '' from t group by source having count(distinct split) > 1""")
def split_leakage(spark, sf_dir):
    r = simjoin.leakage(_docs(spark, sf_dir).withColumn("group_id", F.col("source")))
    return r.select("kind", "key", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("ids"))


def _lines(name: str, key: str) -> str:
    """SQL of (key, line, a: token set) of every line of a table's texts."""
    return f"(select {key}, line, {_TOKS} as a from (select {key}, unnest(string_split(coalesce(text, ''), e'\\n')) as text, unnest(range(len(string_split(coalesce(text, ''), e'\\n')))) as line from {name}))"


@query(f"""with d as (select doc_id, line, len(a) as n, unnest(a) as tok from {_lines('documents', 'doc_id')}), b as (select item_id, line as item_line, len(a) as n, unnest(a) as tok from {_lines('benchmark', 'item_id')})
select doc_id, line, item_id, item_line, round(count(*)::double / (d.n + b.n - count(*)), 9) as score from d join b using (tok) group by doc_id, line, item_id, item_line, d.n, b.n having count(*)::double / (d.n + b.n - count(*)) >= 0.6""")
def benchmark_leakage(spark, sf_dir):
    """Lines of documents that repeat, or nearly, a line of the benchmark."""
    most = 10**6  # a line's place within its text's ids
    each = lambda name, key: table(spark, sf_dir, name).select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text")).select((F.col(key) * most + F.col("line")).alias("row_id"), "text")
    m = simjoin.cross_matches(each("documents", "doc_id"), each("benchmark", "item_id"), 0.6)
    place = lambda c, key, line: [F.floor(F.col(c) / most).cast("bigint").alias(key), (F.col(c) % most).cast("bigint").alias(line)]
    return m.select(*place("left_id", "doc_id", "line"), *place("right_id", "item_id", "item_line"), F.round("score", 9).alias("score"))


@query(f"""with {_T}, e as (select id, len(a) as n, unnest(a) as tok from t), b as (select item_id, len(x) as n, unnest(x) as tok from (select item_id, {_TOKS} as x from benchmark))
select id as doc_id, item_id, round(count(*)::double / (e.n + b.n - count(*)), 9) as score from e join b using (tok) group by id, item_id, e.n, b.n having count(*)::double / (e.n + b.n - count(*)) >= 0.2""")
def benchmark_near_documents(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    return simjoin.cross_matches(_docs(spark, sf_dir), b, 0.2).select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), F.round("score", 9).alias("score"))


@query(f"""with {_PAIRS}, w as (select len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> ''))::bigint as w from documents)
select (select count(*) from t) as n_rows, (select count(distinct fp) from t) as n_distinct, (select count(*) from (select 1 from t where fp <> '' group by fp having count(*) > 1)) as exact_groups,
(select count(*) from near) as near_pairs, min(w) as words_min, list_sort(list(w))[count(*) // 2 + 1] as words_median, max(w) as words_max from w""")
def dataset_summary(spark, sf_dir):
    return simjoin.summary(_docs(spark, sf_dir), textfn.word_count(F.col("text")))


@query("select source, lang, count(*) as n from documents group by all")
def dataset_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


_GREEDY = f"""with recursive {_PAIRS}, nodes as (select id, row_number() over (order by id) as i from (select a as id from near union select b from near)),
fold as (select 0::bigint as i, []::bigint[] as kept union all
select n.i, case when exists (select 1 from near where b = n.id and list_contains(f.kept, a)) then f.kept else list_append(f.kept, n.id) end from fold f join nodes n on n.i = f.i + 1),
keep as (select kept from fold order by i desc limit 1)"""


@query(f"{_GREEDY} select id as row_id from t where fp <> '' and (id not in (select id from nodes) or id in (select unnest(kept) from keep))")
def dedup_greedy(spark, sf_dir):
    return dedup.greedy_dedup(_docs(spark, sf_dir), Store(spark, "dedup")).select("row_id")


@query(f"""{_GREEDY}, r as (select id, row_number() over (order by id) as k from t where fp <> '' and (id not in (select id from nodes) or id in (select unnest(kept) from keep)))
select 'C' || lpad(k::varchar, 4, '0') as id, trim(d.text, e' \\n\\t\\r') as text, d.source, '' as group_id, '' as split, '' as notes from r join documents d on d.doc_id = r.id where k <= 100""")
def build_sheet(spark, sf_dir):
    s = dedup.build_sheet(_docs(spark, sf_dir).drop("split"), 100, Store(spark, "sheet"), seed=None)
    return s.select("id", "text", "source", "group_id", "split", "notes")


@query(f"with recursive {_BOTH} select id as row_id, component from comp")
def dup_components(spark, sf_dir):
    return dedup.duplicate_components(_docs(spark, sf_dir), Store(spark, "comp"))


@query(f"""with recursive {_BOTH}, s as (select component, count(*) as n from comp group by component),
p as (select component, coalesce(sum(n) over (order by component rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from s)
select id as row_id, component, case when before < 0.5 * total then 'test' else 'dev' end as split from comp join p using (component)""")
def assign_splits(spark, sf_dir):
    return dedup.assign_splits(_docs(spark, sf_dir), Store(spark, "splits"), seed=None)


# The same over a seeded shuffle: rows and components in the order of a hash of the seed.
_SEED = 13
_SHUFFLED_T = f"t as (select id, fp, a, doc_id from (select row_number() over (order by {seeded_sql(_SEED, 'doc_id')}, doc_id) - 1 as id, {_FP} as fp, {_TOKS} as a, doc_id from documents))"


@query(f"""{_GREEDY.replace(_T, _SHUFFLED_T)}, r as (select doc_id, row_number() over (order by id) as k from t where fp <> '' and (id not in (select id from nodes) or id in (select unnest(kept) from keep)))
select 'C' || lpad(k::varchar, 4, '0') as id, trim(d.text, e' \\n\\t\\r') as text, d.source from r join documents d using (doc_id) where k <= 100""")
def build_sheet_seeded(spark, sf_dir):
    s = dedup.build_sheet(_docs(spark, sf_dir).drop("split"), 100, Store(spark, "sheet"), seed=_SEED, exact=False)
    return s.select("id", "text", "source")


@query(f"""with recursive {_BOTH}, s as (select component, count(*) as n from comp group by component),
p as (select component, coalesce(sum(n) over (order by {seeded_sql(_SEED, 'component')}, component rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from s)
select id as row_id, component, case when before < 0.3 * total then 'test' else 'dev' end as split from comp join p using (component)""")
def assign_splits_seeded(spark, sf_dir):
    return dedup.assign_splits(_docs(spark, sf_dir), Store(spark, "splits"), 0.3, seed=_SEED)


# --- metrics: gold is the embeddings' label, the prediction is the nearest prototype ----------------------------------------
_CLASSES = list(range(10))


def _scored(spark, sf_dir) -> DataFrame:
    s = _suggested(spark, sf_dir)
    conf = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("suggestion.score") * 2)), 6)
    return s.select("vec_id", F.col("label").alias("gold"), F.col("suggestion.label").alias("pred"), conf.alias("confidence"))


_G = f"{_SUGG}, g as (select vec_id, gold, pred, round(least(1, greatest(0, score * 2)), 6) as confidence from sugg)"
_PC = f"""{_G}, c as (select x as label, count(*) filter (gold = x and pred = x) as tp, count(*) filter (gold <> x and pred = x) as fp, count(*) filter (gold = x and pred <> x) as fn from g, range(10) r(x) group by x),
pr as (select *, case when tp + fp = 0 then 0.0::double else tp::double / (tp + fp) end as p, case when tp + fn = 0 then 0.0::double else tp::double / (tp + fn) end as r from c),
pc as (select label, p, r, tp + fn as support, case when p + r = 0 then 0.0::double else 2 * p * r / (p + r) end as f1 from pr)"""


@query(f"with {_G}, d as (select x as gold, y as pred from range(10) a(x), range(10) b(y)), c as (select gold, pred, count(*) as n from g group by all) select coalesce(d.gold, c.gold)::bigint as gold, coalesce(d.pred, c.pred)::bigint as pred, coalesce(n, 0)::bigint as n from d full join c on d.gold = c.gold and d.pred = c.pred")
def confusion(spark, sf_dir):
    return M.confusion(_scored(spark, sf_dir), _CLASSES).select(F.col("gold").cast("bigint").alias("gold"), F.col("pred").cast("bigint").alias("pred"), "n")


def _classes(spark, sf_dir) -> DataFrame:
    return M.per_class(M.confusion(_scored(spark, sf_dir), _CLASSES), _CLASSES)


@query(f"with {_PC} select label, round(p, 9) as precision, round(r, 9) as recall, round(f1, 9) as f1, support from pc")
def per_class(spark, sf_dir):
    c = _classes(spark, sf_dir)
    return c.select(F.col("label").cast("bigint").alias("label"), *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")], "support")


@query(f"with {_PC} select round(avg(f1) filter (support > 0), 9) as macro_f1 from pc")
def macro_f1(spark, sf_dir):
    return M.macro_f1(_classes(spark, sf_dir)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"with {_G} select round(avg((gold = pred)::int), 9) as accuracy from g")
def accuracy(spark, sf_dir):
    return M.accuracy(_scored(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"))


@query("""with c as (select source, count(*) as n, count(*) filter (lang = 'en') as s from documents group by source), d as (select *, s / n::double as p, 1 + 1.96 * 1.96 / n as q from c),
e as (select *, (p + 1.96 * 1.96 / (2 * n)) / q as mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / q as half from d)
select source, round(greatest(0.0, mid - half), 9) as lo, round(least(1.0, mid + half), 9) as hi from e""")
def wilson(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("s"))
    w = M.wilson(F.col("s"), F.col("n"))
    return c.select("source", F.round(w["lo"], 9).alias("lo"), F.round(w["hi"], 9).alias("hi"))


@query(f"""with {_G}, b as (select k / 10.0::double as lo, (k + 1) / 10.0::double as hi, k from range(10) r(k)),
s as (select count(*) as n, avg((gold = pred)::int) as acc, avg(confidence) as conf from g join b on (confidence >= lo and confidence < hi) or (k = 9 and confidence = 1) group by k)
select round(sum(n * abs(acc - conf)) / (select count(*) from g), 9) as ece from s""")
def ece(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("correct", F.col("gold") == F.col("pred"))
    return M.ece(s).select(F.round("ece", 9).alias("ece"))


@query(f"""with {_G}, o as (select row_number() over (order by confidence desc, vec_id) as i, sum((gold = pred)::int) over (order by confidence desc, vec_id rows unbounded preceding) as hits, count(*) over () as n from g),
k as (select k as point, greatest(1, round_even((select count(*) from g) * k / 10.0, 0)::bigint) as take from range(1, 11) r(k))
select point, round(take / n::double, 9) as coverage, round(hits / take::double, 9) as accuracy from k join o on i = take""")
def risk_coverage(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("correct", F.col("gold") == F.col("pred"))
    return M.risk_coverage(s, order="vec_id").select("point", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


@query("""with o as (select row_number() over (order by c desc, doc_id) as i, sum(ok) over (order by c desc, doc_id rows unbounded preceding) as hits, count(*) over () as n
from (select doc_id, (toxic = 0)::int as ok, case when quality = 1 then 0.9 else 0.5 end as c from labels)),
k as (select k as point, greatest(1, round_even((select count(*) from labels) * k / 20.0, 0)::bigint) as take from range(1, 21) r(k))
select point, round(take / n::double, 9) as coverage, round(hits / take::double, 9) as accuracy from k join o on i = take""")
def risk_coverage_ties(spark, sf_dir):
    """Two confidences only, as where a confidence is clipped: nearly all rows tie."""
    t = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 0).alias("correct"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"))
    return M.risk_coverage(t, order="doc_id", points=20).select("point", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


_KAPPA = """cells as (select a, b, count(*) as k from l group by all), tot as (select sum(k) as n, sum(k) filter (a = b) as same from cells),
pa as (select a as x, sum(k) as ka from cells group by a), pb as (select b as x, sum(k) as kb from cells group by b), pe as (select sum(ka * kb)::double as e from pa join pb using (x)),
kk as (select n::bigint as n, same / n::double as po, e / (n::double * n) as pe from tot, pe)"""


@query(f"with l as (select quality as a, toxic as b from labels), {_KAPPA} select n, round(po, 9) as percent_agreement, round(case when pe = 1 then 1 else (po - pe) / (1 - pe) end, 9) as kappa from kk")
def kappa(spark, sf_dir):
    k = M.kappa(table(spark, sf_dir, "labels"), a="quality", b="toxic")
    return k.select("n", F.round("percent_agreement", 9).alias("percent_agreement"), F.round("kappa", 9).alias("kappa"))


def _annotated(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label_a"), F.col("toxic").cast("string").alias("label_b"))
    return t.withColumn("urgency_a", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("label_a"))).withColumn("urgency_b", F.lit("1"))


@query(f"""with l as (select quality as a, toxic as b from labels), {_KAPPA} select 'label' as field, n, round(po, 9) as percent_agreement, round((po - pe) / (1 - pe), 9) as kappa from kk
union all select * from (with l as (select quality as a, 1 as b from labels where doc_id % 3 <> 0), {_KAPPA} select 'urgency', n, round(po, 9), round(case when pe = 1 then 1 else (po - pe) / (1 - pe) end, 9) from kk)""")
def agreement(spark, sf_dir):
    a = M.agreement(_annotated(spark, sf_dir))
    return a.select("field", "n", F.round("percent_agreement", 9).alias("percent_agreement"), F.round("kappa", 9).alias("kappa"))


@query("select doc_id from labels where quality <> toxic or (doc_id % 3 <> 0 and quality <> 1)")
def disagreements(spark, sf_dir):
    return M.disagreements(_annotated(spark, sf_dir)).select("doc_id")


_KAPPAS = """l as (select source, quality as a, toxic as b from labels join documents using (doc_id)), n as (select source, count(*) as n, count(*) filter (a = b) / count(*)::double as po from l group by source),
e as (select source, sum(ka * kb) as e from (select source, a as x, count(*) as ka from l group by all) join (select source, b as x, count(*) as kb from l group by all) using (source, x) group by source),
ks as (select source, n, (po - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)) as k from n left join e using (source))"""


@query(f"with {_KAPPAS} select source, case when k + 0.7 >= 0.8 then 'almost perfect' when k + 0.7 >= 0.7 then 'good - acceptable for a gold set' when k + 0.7 >= 0.6 then 'moderate - tighten the guidelines' else 'poor - do not use as ground truth' end as said from ks")
def interpret_kappa(spark, sf_dir):
    # the annotations agree by chance only, so their kappas are moved to where the bounds of the levels are
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return M.kappa(t, ["source"], "quality", "toxic").select("source", rules.interpret_kappa(F.col("kappa") + 0.7).alias("said"))


@query("""with u as (select count(*) filter (toxic = 1 and n_chars > 1000) as tp, count(*) filter (toxic = 1 and n_chars <= 1000) as fn, count(*) filter (toxic = 0 and n_chars > 1000) as fp, count(*) filter (toxic = 0 and n_chars <= 1000) as tn
from labels join documents using (doc_id)), v as (select *, (tp + fn)::double as n, tp::double / (tp + fn) as p, 1 + 1.96 * 1.96 / (tp + fn) as q from u),
w as (select *, (p + 1.96 * 1.96 / (2 * n)) / q as mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / q as half from v)
select tp, fn, fp, tn, round(p, 9) as recall, round(greatest(0, mid - half), 9) as recall_lo, round(least(1, mid + half), 9) as recall_hi, round(tp::double / (tp + fp), 9) as precision, round(tn::double / (tn + fp), 9) as specificity, tp + fn as positives from w""")
def urgency_report(spark, sf_dir):
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    r = M.urgency_report(t.withColumn("pred", (F.col("n_chars") > 1000).cast("int")), "toxic", "pred", 1)
    return r.select("tp", "fn", "fp", "tn", *[F.round(c, 9).alias(c) for c in ("recall", "recall_lo", "recall_hi", "precision", "specificity")], "positives")


def _headline(spark, sf_dir) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("gold_urgency", (F.col("gold") < 3).cast("int")).withColumn("pred_urgency", F.col("pred").between(0, 2).cast("int"))
    return M.score(s, _CLASSES, unclear=-1, positive=1)


_HEAD = f"""{_PC}, h as (select count(*) as n, count(*) filter (gold = pred) as ok, count(*) filter (pred <> -1) as answered, count(*) filter (pred <> -1 and gold = pred) as answered_ok,
count(*) filter (gold >= 3 and pred between 0 and 2) as over_triage, count(*) filter (gold < 3 and pred not between 0 and 2) as under_triage, count(*) filter (gold < 3) as urgent_cases from g)"""


@query(f"""with {_HEAD} select n, round(ok / n::double, 9) as accuracy, round((select avg(f1) from pc where support > 0), 9) as macro_f1, round(1 - answered / n::double, 9) as abstain_rate,
round(answered_ok / answered::double, 9) as accuracy_when_answered, over_triage, under_triage, round((urgent_cases - under_triage) / urgent_cases::double, 9) as urgent_recall, urgent_cases from h""")
def score(spark, sf_dir):
    s = _headline(spark, sf_dir)
    return s.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "abstain_rate", "accuracy_when_answered")], "over_triage", "under_triage", F.round("urgent_recall", 9).alias("urgent_recall"), "urgent_cases")


@query(f"""with {_HEAD}, v as (select (urgent_cases - under_triage) / urgent_cases::double as u, ok / n::double as a from h)
select 'urgent_recall' as failure from v where u < 0.95 union all select 'accuracy' from v where a < 0.5 union all select 'macro_f1' from v where (select avg(f1) from pc where support > 0) < 0.01""")
def gate(spark, sf_dir):
    none = spark.createDataFrame([], "kind string")
    return M.gate(_headline(spark, sf_dir), none, 0.95, 0.01, 0.5)


@query(f"""with {_HEAD}, {_PAIRS}, v as (select (urgent_cases - under_triage) / urgent_cases::double as u from h)
select 'urgent_recall' as failure from v where u < 0.95 union all select 'leakage' where exists (select 1 from near where a % 2 <> b % 2)""")
def gate_with_leakage(spark, sf_dir):
    """The gate over splits that share documents."""
    return M.gate(_headline(spark, sf_dir), simjoin.leakage(_docs(spark, sf_dir)), 0.95, 0.0, 0.0)


@query("""select round(avg((want = got)::int), 9) as red_flag_recall, count(*) as red_flag_cases from (select case when quality = 1 then 'a' else '' end as want, case when toxic = 1 then '' else 'a' end as got from labels) where want <> ''""")
def red_flag_recall(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "a;").otherwise("").alias("red_flags"), F.when(F.col("toxic") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("pred_flags"))
    r = M.red_flag_recall(t)
    return r.select(F.round("red_flag_recall", 9).alias("red_flag_recall"), "red_flag_cases")


# --- sources and joins ----------------------------------------------------------------------------------------------
@query("""with p as (select doc_id::varchar as id, quality::varchar as pred_label from labels) select d.doc_id::varchar as id, p.pred_label from documents d join p on p.id = d.doc_id::varchar""")
def join_predictions(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("pred_label"), F.lit("").alias("pred_urgency"), F.col("doc_id").alias("row_id"))
    older = lab.withColumn("pred_label", F.lit("old")).withColumn("row_id", F.col("row_id") - 10**6)  # the last duplicate wins
    gold = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("row_id"))
    return io.join_predictions(gold, lab.unionByName(older)).select("id", "pred_label")


@query("select doc_id, quality, toxic from labels where quality <> toxic")
def error_rows(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select("*", F.col("quality").alias("label"), F.col("toxic").alias("pred_label"), F.lit("x").alias("urgency"), F.lit("x").alias("pred_urgency"))
    return io.errors(t).select("doc_id", "quality", "toxic")


@query("select doc_id::varchar as doc_id, sha256(coalesce(text, '')) as text_sha256, coalesce(lang, '') as lang, 1::bigint as copies from documents")
def csv_scan(spark, sf_dir):
    """Documents written as CSV files with all their line breaks and quotes, read again by ranges."""
    path = Store(spark, "csv").root
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    t.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    r = io.read_large_csv(spark, path)
    return r.groupBy("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang").agg(F.count_distinct("row_id").alias("copies"))


@query("select page_id, sha256(html) as content_hash, len(html)::bigint as result from pages")
def content_cache(spark, sf_dir):
    """Pages through a read-through cache: a third of them is kept before, the others are computed and kept now."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    compute = lambda misses: misses.select("key", F.length(F.decode("content", "UTF-8")).cast("string").alias("result"))
    cache = Store(spark, "cache").root
    remote.cached_results(files.where("cast(path as bigint) % 3 = 0"), cache, "m", "ar", compute)
    r = remote.cached_results(files, cache, "m", "ar", compute)
    return r.select(F.col("path").cast("bigint").alias("page_id"), F.substring_index("key", "_", 1).alias("content_hash"), F.col("result").cast("bigint").alias("result"))
