"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Each source's documents stand in a shuffled order (by md5 of doc_id) and their words, end to end, form a
stream cut into blocks of equally many words (the last may be shorter; small sources have smaller blocks, so
that a source is at least BLOCKS_LEAST blocks where its words allow). Slot i of the mix has the golden-ratio
point frac(i * phi), which the cumulative weights of the sources map to one source. Slots are ranked in each
source; slot r of a source takes its block r mod (number of blocks), until the source's quota is met.

Ranks and stream offsets are two-step prefix sums: sums of bounded chunks first, then a rank or sum in each
chunk, so a source with a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridex.session import Store

BLOCK_WORDS = 1024
BLOCKS_LEAST = 256
SLOT_CHUNK = 1 << 16
PHI = 0.6180339887498949
#: Weights by the sources' code point order, repeating; the mix's share of all words; times that a source may be taken.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
TIMES = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame) -> DataFrame:
    """A row per source: source, source_size, target, block, blocks, quota.

    The excess of capped sources is reshared by weight until none is above its cap; that is target =
    min(cap, level * weight) for the level at which the targets add up. Sources are ranked by cap / weight; the
    first k of them are capped, k being the least for which the next one is not above its cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", TIMES * F.col("source_size").cast("double"))
    order = [(F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caps, ws = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.lit(SHARE) * F.sum("source_size").over(everything) - caps) / (F.sum("w").over(everything) - ws)
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"]
    per = per.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))))
    size = F.col("source_size")
    per = per.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(size / BLOCKS_LEAST))).cast("bigint"))
    per = per.withColumn("blocks", F.ceil(size / F.col("block")).cast("bigint"))
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    quota = passes * F.col("blocks") + F.when(size > 0, F.least(F.col("blocks"), F.round((F.col("target") - passes * size) / F.col("block")))).otherwise(0)
    return per.withColumn("quota", F.least(quota, TIMES * F.col("blocks")).cast("bigint")).select("source", "source_size", "target", "block", "blocks", "quota")


def schedule(spark, per: DataFrame) -> DataFrame:
    """slot, source, n (rank in its source from 0), block_no: the mix in order; per: from targets(), a row per source."""
    rows = per.where("quota > 0").orderBy(F.col("source").asc_nulls_last()).collect()  # one row per source
    total = sum(r.quota for r in rows)
    if not rows:
        return spark.createDataFrame([], "slot bigint, source string, n bigint, block_no bigint")
    # Golden-ratio points fall short of a source's share by a few slots at most; surplus ones are dropped by quota.
    slots = spark.range(0, total + total // 50 + 64 * len(rows), 1).withColumnRenamed("id", "slot")
    point = F.col("slot") * F.lit(PHI) - F.floor(F.col("slot") * F.lit(PHI))
    edge, cum = [], 0
    for r in rows:
        cum += r.quota
        edge.append(cum / total)
    edge[-1] = 2.0
    s = F.size(F.filter(F.array(*[F.lit(e) for e in edge]), lambda e: e <= point))
    slots = slots.select("slot", s.alias("s"), F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    past = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = slots.groupBy("s", "chunk").agg(F.count("*").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(past), F.lit(0)))
    here = Window.partitionBy("s", "chunk").orderBy("slot")
    ranked = slots.withColumn("r", F.row_number().over(here)).join(base, ["s", "chunk"]).withColumn("n", F.col("base") + F.col("r") - 1)
    known = spark.createDataFrame([(i, r.source, r.quota, r.blocks) for i, r in enumerate(rows)], "s int, source string, quota bigint, blocks bigint")
    return ranked.join(F.broadcast(known), "s").where("n < quota").select("slot", "source", "n", F.pmod("n", "blocks").alias("block_no"))


def stream(sized: DataFrame, per: DataFrame) -> DataFrame:
    """Each document's place in its source's shuffled stream: columns of sized, block, start (words before it)."""
    x = sized.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("chunk", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    x = x.withColumn("src", F.coalesce("source", F.lit(""))).withColumn("nul", F.col("source").isNull())
    past = Window.partitionBy("src", "nul").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("src", "nul", "chunk").agg(F.sum("size").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(past), F.lit(0))).drop("k")
    here = Window.partitionBy("src", "nul", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("in", F.coalesce(F.sum("size").over(here), F.lit(0))).join(base, ["src", "nul", "chunk"]).withColumn("start", F.col("base") + F.col("in"))
    keyed = per.select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("nul"), "source_size", "target", "block", "blocks", "quota")
    return x.join(keyed, ["src", "nul"])


def mix(docs: DataFrame, store: Store) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row: the words that the mix takes of it, repeats counted.

    A null text has size 0. A null source is a source of its own, the last. Rows that repeat a doc_id each get a
    row (equal ones stand in any order). Sources without words have target 0. More columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    sized = store.save(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    per = store.save(targets(sized), "targets")
    placed = store.save(stream(sized, per), "stream")
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    spans = placed.where("size > 0").withColumn("block_no", F.explode(F.sequence(first, last)))
    lo = F.greatest("start", F.col("block_no") * F.col("block"))
    hi = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block"))
    spans = spans.select("doc_id", "src", "nul", "start", "size", "block_no", (hi - lo).alias("words"))
    used = schedule(spark, per).groupBy(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("nul"), "block_no").agg(F.count("*").alias("times"))
    # A document is its source and its place in the stream; wordless ones share places and take nothing.
    took = spans.join(used, ["src", "nul", "block_no"]).groupBy("src", "nul", "start").agg(F.sum(F.col("words") * F.col("times")).alias("got"))
    out = placed.join(took, ["src", "nul", "start"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(0).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


MIX_SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
p as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as k from d group by source),
q as (select *, case k when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, 2 * source_size::double as cap from p),
r as (select *, (1.5 * (sum(source_size) over ())::double - coalesce(sum(cap) over b, 0)) / ((sum(w) over ()) - coalesce(sum(w) over b, 0)) as level
      from q window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select arg_min(level, cap / w) as level from r where level * w <= cap),
t as (select source, source_size, least(cap, coalesce((select level from l) * w, cap)) as target,
      greatest(1, least({BLOCK_WORDS}, source_size // {BLOCKS_LEAST})) as block from q),
u as (select *, ceil(source_size / block)::bigint as blocks, case when source_size > 0 then floor(target / source_size) else 0 end as passes from t),
v as (select *, case when source_size > 0 then least(blocks, round((target - passes * source_size) / block)) else 0 end as part from u),
o as (select d.*, v.source_size, v.target, v.block, v.blocks, least(passes * blocks + part, 2 * blocks)::bigint as quota,
      coalesce(sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, '')), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join v on d.source is not distinct from v.source)
select doc_id, source, size, source_size, target,
  (case when blocks > 0 then (quota // blocks) * size + greatest(0, least(start + size, (quota % blocks) * block) - start) else 0 end)::bigint as taken
from o
"""


def mix_rows(docs: DataFrame, store: Store) -> DataFrame:
    """The mix as rows of docs: each row as often (0, 1 or 2 times) as the mix takes its words, to the nearest whole.

    Rows without words hold nothing to mix and go. Rows equal in doc_id and text share one place in the mix.
    """
    keyed = docs.withColumn("_dk", F.xxhash64("doc_id", "text"))
    one = keyed.groupBy("_dk", "source").agg(F.min("text").alias("text")).select(F.col("_dk").alias("doc_id"), "source", "text")
    taken = mix(one, store).where("size > 0").groupBy("doc_id").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("_n")).where("_n > 0")
    out = keyed.join(taken.withColumnRenamed("doc_id", "_dk"), "_dk")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)
