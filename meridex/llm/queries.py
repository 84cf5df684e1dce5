"""Queries of this package: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridex.llm import dialogue, html, infill, jaccard, lines, mixing, packing, personal, pitman_yor, tokens, toxicity, vectors
from meridex.session import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The default place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_topk(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.permutation_search(table(spark, sf_dir, "embeddings"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Store(spark, "op5")).select("doc_id", "size", "source_size", "target", "taken")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), Store(spark, "op6"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), Store(spark, "op8"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"), Store(spark, "op9"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, Store(spark, "op10")).select("doc_id", "text", "n_lines", "n_removed")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damage(c), c, Store(spark, "op12"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_exact_topk_search, op2_token_counts, op3_toxicity, op4_approximate_nearest_neighbours, op5_mixing_sources,
              op6_best_fit_packing, op7_html_extraction, op8_ngram_jaccard_join, op9_lm_scoring, op10_line_dedup,
              op11_personal_data, op12_conversation_repair, op13_fill_in_middle)
}

_TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_JACCARD_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents),
s as (select distinct doc_id, unnest(case when len(a) >= 5 then list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' '))
      when len(a) > 0 then [array_to_string(a, ' ')] else []::varchar[] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r as (select a as doc_id, a as c from (select distinct a from e) union select e.b, r.c from r join e on e.a = r.doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, w.doc_id)::bigint as component_id
from w left join n using (doc_id) left join (select doc_id, min(c) as c from r group by doc_id) m using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_exact_topk_search": _TOPK_SQL,
    "op5_mixing_sources": mixing.MIX_SQL.replace("select doc_id, source, size, source_size, target,\n", "select doc_id, size, source_size, target,\n"),
    "op8_ngram_jaccard_join": _JACCARD_SQL,
    "op12_conversation_repair": dialogue.REPAIR_SQL,
    "op13_fill_in_middle": infill.INFILL_SQL,
}
