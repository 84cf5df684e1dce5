"""Evaluation metrics as aggregates. Tables carry gold and pred columns; every 0/0 is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridex.functions import vocabulary as V
from meridex.operators.order import running
from meridex.session import Store


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def confusion(df: DataFrame, labels: list, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """gold, pred, n over all pairs of labels, and pairs outside of them that occur."""
    kind = df.schema[gold].dataType
    dom = df.sparkSession.createDataFrame([(x,) for x in labels], "x " + kind.simpleString())
    dense = dom.select(F.col("x").alias("gold")).join(dom.select(F.col("x").alias("pred")), F.lit(True))  # the label domain squared
    seen = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return dense.join(seen, ["gold", "pred"], "full").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(conf: DataFrame, labels: list) -> DataFrame:
    """label, precision, recall, f1, support from confusion counts, in one pass over them."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    miss = F.when(F.col("gold") != F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.explode(F.array(
        F.struct(F.col("gold").alias("label"), hit.alias("tp"), zero.alias("fp"), miss.alias("fn")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), miss.alias("fp"), zero.alias("fn"))))
    t = conf.select(sides.alias("s")).select("s.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).where(F.col("label").isin(labels))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    t = t.select("label", p.alias("precision"), r.alias("recall"), (F.col("tp") + F.col("fn")).alias("support"))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.when(F.col(gold) == F.col(pred), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def macro_f1(classes: DataFrame) -> DataFrame:
    """Mean F1 of the classes that gold has."""
    return classes.where("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """struct(lo, hi): the Wilson interval, (0, 0) for no cases."""
    n = F.when(total == 0, 1.0).otherwise(total.cast("double"))
    p = successes / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    lo, hi = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.struct(F.when(total == 0, 0.0).otherwise(lo).alias("lo"), F.when(total == 0, 0.0).otherwise(hi).alias("hi"))


def ece(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Expected calibration error. A confidence outside of [0, 1] counts as a case but falls in no bin."""
    c = F.col(confidence)
    where = F.lit(None).cast("int")
    for b in range(bins):  # edges as the division gives them; floor(c * bins) would misplace some
        where = F.when((c >= b / bins) & (c < (b + 1) / bins), b).otherwise(where)
    where = F.when(c == 1.0, bins - 1).otherwise(where)
    g = df.groupBy(where.alias("b")).agg(F.count("*").alias("k"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(c).alias("conf"))
    gap = F.when(F.col("b").isNotNull(), F.col("k") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return g.agg(F.coalesce(F.sum(gap) / F.sum("k"), F.lit(0.0)).alias("ece"))


def risk_coverage(df: DataFrame, confidence: str = "confidence", correct: str = "correct", order: str = "row_id", points: int = 10, store: Store | None = None) -> DataFrame:
    """point, coverage, accuracy when only the most confident are answered; ties go by `order`, rows without a confidence come last.

    Ranks and hits are made by ranges of (confidence, order), so rows of one confidence are dealt over tasks as well.
    """
    x = df.select(F.col(confidence).alias("c"), F.col(correct).cast("int").alias("ok"), F.col(order).alias("o"))
    r = running(x, [F.desc_nulls_last("c"), F.asc("o")], store or Store(df.sparkSession, "coverage"), {"hits": F.col("ok")}).select(F.col("rank").alias("take"), "hits")
    ks = df.sparkSession.range(1, points + 1).withColumnRenamed("id", "point")
    n = df.agg(F.count("*").alias("n"))
    ks = ks.join(n, F.lit(True)).select("point", "n", F.when(F.col("n") > 0, F.greatest(F.lit(1.0), F.rint(F.col("n") * F.col("point") / points))).otherwise(0.0).cast("bigint").alias("take"))
    got = ks.join(r, "take", "left")
    return got.select("point", F.when(F.col("n") > 0, F.col("take") / F.col("n")).otherwise(0.0).alias("coverage"), F.coalesce(F.when(F.col("take") > 0, F.col("hits") / F.col("take")), F.lit(0.0)).alias("accuracy"))


def kappa(df: DataFrame, by: list[str] | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """n, percent_agreement, kappa (for each value of `by`) between two annotators."""
    keys = by or []
    cells = df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("k"))
    pa = cells.groupBy(*keys, F.col("a").alias("x")).agg(F.sum("k").alias("ka"))
    pb = cells.groupBy(*keys, F.col("b").alias("x")).agg(F.sum("k").alias("kb"))
    chance = pa.join(pb, [*keys, "x"]).groupBy(*keys).agg(F.sum(F.col("ka") * F.col("kb").cast("double")).alias("e"))
    seen = cells.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0)).alias("same"))
    both = seen.join(chance, keys, "left") if keys else seen.join(chance, F.lit(True), "left")
    n, po = F.coalesce("n", F.lit(0)), ratio(F.coalesce("same", F.lit(0)), F.coalesce("n", F.lit(0)))
    pe = ratio(F.coalesce("e", F.lit(0.0)), n.cast("double") * n)
    k = F.when(n == 0, 0.0).when(pe == 1, 1.0).otherwise((po - pe) / F.when(pe == 1, 1.0).otherwise(1 - pe))
    return both.select(*keys, n.alias("n"), po.alias("percent_agreement"), k.alias("kappa"))


def urgency_report(df: DataFrame, gold: str = "gold", pred: str = "pred", positive: object = V.URGENT) -> DataFrame:
    """One row: tp, fn, fp, tn, recall and its interval, precision, specificity, positives."""
    g, p = F.col(gold) == F.lit(positive), F.col(pred) == F.lit(positive)
    t = df.agg(F.count_if(g & p).alias("tp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & p).alias("fp"), F.count_if(~g & ~p).alias("tn"))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    ci = wilson(tp, tp + fn)
    return t.select("tp", "fn", "fp", "tn", ratio(tp, tp + fn).alias("recall"), ci["lo"].alias("recall_lo"), ci["hi"].alias("recall_hi"),
                    ratio(tp, tp + fp).alias("precision"), ratio(tn, tn + fp).alias("specificity"), (tp + fn).alias("positives"))


def agreement(df: DataFrame, fields: tuple[str, ...] = ("label", "urgency")) -> DataFrame:
    """field, n, percent_agreement, kappa over rows that both annotators have filled in."""
    from meridex.functions.textfn import strip

    one = lambda f, s: strip(F.coalesce(F.col(f"{f}_{s}").cast("string"), F.lit("")))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), one(f, "a").alias("a"), one(f, "b").alias("b")) for f in fields])).alias("x")).select("x.*")
    got = kappa(long.where("a <> '' and b <> ''"), ["field"])
    names = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return names.join(got, "field", "left").fillna({"n": 0, "percent_agreement": 0.0, "kappa": 0.0})


def disagreements(df: DataFrame, fields: tuple[str, ...] = ("label", "urgency")) -> DataFrame:
    """Rows that both annotators have filled in, differently, for some field."""
    from meridex.functions.textfn import strip

    out = F.lit(False)
    for f in fields:
        a, b = (strip(F.coalesce(F.col(f"{f}_{s}").cast("string"), F.lit(""))) for s in "ab")
        out = out | ((a != "") & (b != "") & (a != b))
    return df.where(out)


def red_flag_recall(df: DataFrame, want: str = "red_flags", got: str = "pred_flags") -> DataFrame:
    """red_flag_recall, red_flag_cases over rows with flags; want is a ;-joined text."""
    wanted = F.filter(F.split(F.col(want), ";"), lambda x: x != "")
    found = F.coalesce(F.col(got), F.array().cast("array<string>"))
    hit = F.size(F.array_except(wanted, found)) == 0
    return df.where(f"coalesce({want}, '') <> ''").agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("red_flag_recall"), F.count("*").alias("red_flag_cases"))


def score(df: DataFrame, labels: list, unclear: object = V.UNCLEAR, positive: object = V.URGENT) -> DataFrame:
    """One row of headline figures. df: gold, pred, gold_urgency, pred_urgency."""
    ok, answered = F.col("gold") == F.col("pred"), F.col("pred") != F.lit(unclear)
    gu, pu = F.col("gold_urgency") == F.lit(positive), F.col("pred_urgency") == F.lit(positive)
    t = df.agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"), F.count_if(answered).alias("answered"), F.count_if(answered & ok).alias("answered_correct"),
               F.count_if(~gu & pu).alias("over_triage"), F.count_if(gu & ~pu).alias("under_triage"))
    ci = wilson(F.col("correct"), F.col("n"))
    macro = macro_f1(per_class(confusion(df, labels), labels))
    urg = urgency_report(df, "gold_urgency", "pred_urgency", positive).select(F.col("recall").alias("urgent_recall"), F.col("positives").alias("urgent_cases"))
    return t.join(macro, F.lit(True)).join(urg, F.lit(True)).select(  # one row each
        "n", ratio(F.col("correct"), F.col("n")).alias("accuracy"), ci["lo"].alias("accuracy_lo"), ci["hi"].alias("accuracy_hi"), "macro_f1",
        F.when(F.col("n") == 0, 0.0).otherwise(1 - ratio(F.col("answered"), F.col("n"))).alias("abstain_rate"), ratio(F.col("answered_correct"), F.col("answered")).alias("accuracy_when_answered"),
        "over_triage", "under_triage", "urgent_recall", "urgent_cases")


def gate(scored: DataFrame, leaks: DataFrame, min_urgent_recall: float = 0.95, min_macro_f1: float = 0.0, min_accuracy: float = 0.0) -> DataFrame:
    """failure: a row for each condition that fails; none means that the gate is passed."""
    leak = leaks.limit(1).select(F.lit("leakage").alias("failure"))
    checks = [("urgent_recall", min_urgent_recall), ("macro_f1", min_macro_f1), ("accuracy", min_accuracy)]
    low = scored.select(F.explode(F.filter(F.array(*[F.when(F.col(c) < m, F.lit(c)) for c, m in checks]), lambda x: x.isNotNull())).alias("failure"))
    return leak.unionByName(low)
