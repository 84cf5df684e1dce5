"""Ranks and running totals by ranges, under ties and in seeded orders."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meridex.functions import metrics as M
from meridex.operators import dedup
from meridex.operators.order import running, seeded
from meridex.session import Store


def test_running_against_sort(spark, store):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0.9, 0.9, 0.9, 0.5]), rng.choice([None, 1, 2])) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id int, c double, w int").repartition(7)
    got = {r.row_id: (r["rank"], r.total) for r in running(df, [F.desc_nulls_last("c"), F.asc("row_id")], store, {"total": F.col("w")}, 6).collect()}
    total, want = 0, {}
    for k, (i, _, w) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))):
        total += w or 0
        want[i] = (k + 1, total)
    assert got == want
    assert running(df.limit(0), [F.col("row_id")], store).count() == 0


def test_a_million_equal_confidences_over_many_tasks(spark, store):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit(0.9).alias("confidence"), (F.col("id") % 3 == 0).alias("correct"))
    parts = df.repartitionByRange(16, F.desc("confidence"), "row_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 2 * n / 16
    rc = M.risk_coverage(df, store=store).orderBy("point").collect()
    assert [(r.coverage, r.accuracy) for r in rc] == [(k / 10, -(-(n * k // 10) // 3) / (n * k // 10)) for k in range(1, 11)]


def test_seeded_order_is_a_shuffle(spark, store):
    df = spark.range(500).select((F.col("id") * 10**12).alias("row_id"), F.lit("x").alias("text"))
    got = {r.h: r.row_id for r in df.select(seeded(13, "row_id").alias("h"), "row_id").collect()}
    assert set(got) == {int(hashlib.md5(f"13:{i * 10**12}".encode()).hexdigest()[:15], 16) for i in range(500)}
    a, b = (sorted(r.row_id for r in dedup.shuffled(df, s, exact=False, store=store).collect()) for s in (1, 2))
    assert a == b == list(range(500))
    first = lambda seed: dedup.shuffled(df.withColumn("own", F.col("row_id")), seed, False, store).orderBy("row_id").first().own
    assert first(1) == first(1) and len({first(s) for s in range(4)}) > 1


def test_sheets_and_splits_by_seed(spark, store):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=6)) + f" t{i // 2}", "s") for i in range(120)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, source string")
    sheet = lambda seed, exact: [r.text for r in dedup.build_sheet(df, 20, Store(spark, "s"), seed, 0.8, exact).orderBy("id").collect()]
    for exact in (True, False):
        assert sheet(1, exact) == sheet(1, exact) != sheet(2, exact)
    s = dedup.assign_splits(df, store, 0.25, 13, 0.8).collect()
    by = {}
    for r in s:
        by.setdefault(r.component, set()).add(r.split)
    share = sum(r.split == "test" for r in s) / len(s)
    largest = max(sum(r.component == c for r in s) for c in by)
    assert all(len(v) == 1 for v in by.values()) and 0.25 <= share <= 0.25 + largest / len(s)


def test_exact_permutation_is_for_small_pools(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SMALL_POOL", 3)
    with pytest.raises(ValueError, match="exact=False"):
        dedup.shuffled(spark.range(4).withColumnRenamed("id", "row_id"), 1)
