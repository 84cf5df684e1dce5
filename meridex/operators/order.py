"""Ranks and running totals over a total order of any size, without one task that sees all rows.

Rows are dealt by ranges of the order, whose bounds Spark samples over all its columns: with a row id as the last of them, rows that
tie in the others are dealt over tasks too. A range's own sums, and the sums of the ranges before it, give the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridex.session import Store


def running(df: DataFrame, by: list[Column], store: Store, sums: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """df with rank (from 1, by the order `by`, which should leave no ties) and for each of `sums` its total up to and with the row.

    parts: ranges, by default the session's shuffle partitions. The sums of ranges are a row for each of them; nothing else is put together.
    """
    sums = sums or {}
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(n, *by).sortWithinPartitions(*by)
    x = store.save(dealt.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    x = x.select("*", F.shiftright("_m", 33).alias("_p"), (F.col("_m") - F.shiftleft(F.shiftright("_m", 33), 33)).alias("_i")).drop("_m")
    past = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over n rows at most
    base = x.groupBy("_p").agg(F.count("*").alias("_k"), *[F.sum(f"_{k}").alias(f"_s_{k}") for k in sums])
    base = base.select("_p", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}0") for c in ["_k", *(f"_s_{k}" for k in sums)]])
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    upto = x.withColumns({f"_t_{k}": F.sum(f"_{k}").over(inside) for k in sums}) if sums else x
    out = upto.join(F.broadcast(base), "_p")
    return out.select(*df.columns, (F.col("_k0") + F.col("_i") + 1).alias("rank"), *[(F.col(f"_s_{k}0") + F.coalesce(f"_t_{k}", F.lit(0))).alias(k) for k in sums])


def seeded(seed: int, of: str) -> Column:
    """A number of 60 bits from the seed and a column: an order that depends on nothing else, the same in SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(of).cast("string"))), 1, 15), 16, 10).cast("bigint")


def seeded_sql(seed: int, of: str) -> str:
    return f"('0x' || md5('{seed}:' || {of}::varchar)[1:15])::bigint"
