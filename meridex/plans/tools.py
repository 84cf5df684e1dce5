"""Command lines over CSV files: `python -m meridex.plans.tools checks|sheet|agreement`.

checks: figures of a gold file and its leaks; exit 1 on a leak. sheet: an annotation sheet of distinct texts of a pool.
agreement: how far two annotators agree, and the cases to be decided.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridex.functions import metrics as M
from meridex.functions.rules import interpret_kappa
from meridex.functions.textfn import word_count
from meridex.operators import dedup, simjoin
from meridex.session import Store
from meridex.sources import io

# Names of the leaks, by kind.
LEAKS = {"exact": "cross-split exact duplicates", "near": "cross-split near duplicates ", "group": "cross-split group ids       "}


def _with(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns, empty where a file lacks them."""
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns})


def checks(spark: SparkSession, path: str, threshold: float = 0.9) -> tuple[dict, dict]:
    """Figures and counts of a file, and the number of leaks of each kind."""
    rows = _with(io.read_csv(spark, path), "label", "split", "source", "group_id")
    figures = simjoin.summary(rows, word_count(F.col("text")), threshold).first().asDict()
    for c in ("label", "split", "source"):
        figures[f"by_{c}"] = {r[0]: r[1] for r in rows.groupBy(c).count().orderBy(F.desc("count"), c).collect()}
    found = {r.kind: r["count"] for r in simjoin.leakage(rows, threshold).groupBy("kind").count().collect()}
    return figures, {k: found.get(k, 0) for k in LEAKS}


def _checks(spark: SparkSession, a: argparse.Namespace) -> int:
    figures, leaks = checks(spark, a.csv, a.near_dup_threshold)
    for k, v in figures.items():
        print(f"{k}: {v}")
    for k, name in LEAKS.items():
        print(f"{name}: {leaks[k]}")
    return int(any(leaks.values()))


def _sheet(spark: SparkSession, a: argparse.Namespace) -> int:
    pool = io.read_csv(spark, a.csv)
    n = io.write_csv(dedup.build_sheet(pool, a.n, Store(spark, "sheet"), a.seed, a.near_dup_threshold).orderBy("id"), a.out, dedup.SHEET_COLUMNS)
    print(f"wrote {n} unique texts to {a.out}")
    return 0


def _agreement(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _with(io.read_csv(spark, a.csv), *dedup.SHEET_COLUMNS)
    for r in M.agreement(rows).withColumn("said", interpret_kappa(F.col("kappa"))).orderBy("field").collect():
        print(f"{r.field:8s} n={r.n:4d}  agreement={r.percent_agreement:.1%}  kappa={r.kappa:.3f} ({r.said})")
    todo = M.disagreements(rows)
    print(f"cases needing adjudication: {todo.count()}")
    if a.disagreements:
        io.write_csv(todo.orderBy("row_id"), a.disagreements, dedup.SHEET_COLUMNS)
        print(f"wrote {a.disagreements}")
    return 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="tool", required=True)
    for name, run in (("checks", _checks), ("sheet", _sheet), ("agreement", _agreement)):
        p = sub.add_parser(name)
        p.add_argument("csv")
        p.set_defaults(run=run)
        if name != "agreement":
            p.add_argument("--near-dup-threshold", type=float, default=0.9)
        if name == "sheet":
            p.add_argument("--out", required=True)
            p.add_argument("--n", type=int, default=400)
            p.add_argument("--seed", type=int, default=13)
        if name == "agreement":
            p.add_argument("--disagreements", help="CSV of the cases to be decided")
    a = ap.parse_args(argv)
    return a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
