"""Connected components by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.session import Store


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star pass over edges (u > v).

    Each minimum is a map-side combined aggregate joined back, so a hub's neighbours never
    have to stand in one task: the join may be split by AQE.
    """
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, store: Store, max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph.

    edges: any two columns of one orderable type; loops, repeats and nulls are ignored.
    Returns (node, component) for every node of a proper edge; component is the least node.
    Raises if it has not converged after max_rounds (rounds grow with the logarithm of the size).
    """
    a, b = edges.columns[:2]
    e = store.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("u <> v").distinct(), "edges",
    )
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        new = store.save(_stars(e), "stars")
        store.drop(e)
        e, was, mark = new, mark, _mark(new)
        if mark == was:
            break
    else:
        raise RuntimeError("connected_components: not converged")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])
