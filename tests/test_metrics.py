import pytest
from pyspark.sql import functions as F

from meridex.functions import metrics as M
from meridex.plans import engines, report
from meridex.sources import io


def pairs(spark, gold, pred):
    return spark.createDataFrame(list(zip(gold, pred, strict=True)), "gold string, pred string")


def test_classes(spark):
    df = pairs(spark, "aaabbc", "aabbba")
    c = {r.label: r for r in M.per_class(M.confusion(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    assert c["a"].precision == pytest.approx(2 / 3) and c["b"].recall == 1 and c["c"].f1 == 0
    assert M.accuracy(df).first()[0] == pytest.approx(4 / 6)
    assert M.macro_f1(M.per_class(M.confusion(df, list("abc")), list("abc"))).first()[0] == pytest.approx((2 / 3 + 0.8) / 3)
    assert M.macro_f1(M.per_class(M.confusion(pairs(spark, "aa", "aa"), list("az")), list("az"))).first()[0] == 1


def test_wilson(spark):
    w = spark.createDataFrame([(10, 10), (0, 0)], "s int, n int").select("n", M.wilson(F.col("s"), F.col("n")).alias("w")).collect()
    by = {r.n: r.w for r in w}
    assert by[10].lo < 0.75 and by[10].hi == 1 and tuple(by[0]) == (0, 0)


@pytest.mark.parametrize(("a", "b", "want"), [("abab", "abab", 1.0), ("aabb", "abab", 0.0), ("aabb", "aabx", 0.6), ("aa", "aa", 1.0)])
def test_kappa(spark, a, b, want):
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string")
    assert M.kappa(df).first().kappa == pytest.approx(want)
    assert M.kappa(df.limit(0)).first().kappa == 0


def test_urgency(spark):
    r = M.urgency_report(pairs(spark, ["Urgent", "Urgent", "Urgent", "x", "x"], ["Urgent", "Urgent", "x", "Urgent", "x"])).first()
    assert (r.tp, r.fn, r.fp, r.tn, r.specificity) == (2, 1, 1, 1, 0.5)


def test_calibration(spark):
    f = lambda rows: M.ece(spark.createDataFrame(rows, "confidence double, correct boolean")).first()[0]
    assert f([(0.9, i < 9) for i in range(10)]) == pytest.approx(0)
    assert f([(0.95, i < 1) for i in range(4)]) == pytest.approx(0.7)
    assert f([]) == 0
    rc = M.risk_coverage(spark.createDataFrame([(0.9, True, 0), (0.8, True, 1), (0.2, False, 2), (0.1, False, 3)], "confidence double, correct boolean, row_id int"), points=4).orderBy("point").collect()
    assert rc[0].accuracy == 1 and rc[-1].accuracy == 0.5 and [r.coverage for r in rc] == [0.25, 0.5, 0.75, 1]


GOLD = '﻿id,text,label,urgency,red_flags,split,group_id,source\n1,ألم شديد مستمر يوقظني من النوم,التهاب عصب غير عكوس,Urgent,,test,,\n2,صعوبة في البلع وألم في السن,غير واضح حالياً,Urgent,dysphagia,test,,\n3,"حساسية خفيفة, من ""الحلو""",تسوس سطحي,Non-Urgent,,test,,\n4,دم عند استخدام الخيط,التهاب لثة,Non-Urgent,,dev,,\n'


def test_end_to_end(spark, tmp_path):
    (tmp_path / "g.csv").write_text(GOLD, encoding="utf-8")
    rows = io.labelled(io.read_csv(spark, str(tmp_path / "g.csv")))
    assert [r.id for r in rows.orderBy("row_id").collect()] == ["1", "2", "3", "4"]
    scored = io.select_split(rows)
    ev = report.evaluate(engines.predict("rules", scored), rows)
    assert ev["result"]["n"] == 3 and ev["result"]["accuracy"] == 1 and ev["result"]["red_flag_recall"] == 1 and not ev["failures"]
    text = report.markdown(ev, "rules", "test")
    assert "## Quality gate" in text and "- PASS" in text
    preds = spark.createDataFrame([("1", "x", "Non-Urgent", "0.5", 0), ("1", "غير واضح حالياً", "Non-Urgent", "", 1), ("2", "y", "Non-Urgent", "", 2), ("3", "y", "Non-Urgent", "1", 3)], "id string, pred_label string, pred_urgency string, confidence string, row_id bigint")
    joined = io.join_predictions(scored, preds)
    ev = report.evaluate(joined, rows)
    assert any("urgent recall" in f for f in ev["failures"]) and ev["result"]["under_triage"] == 2
    assert io.write_errors(joined, str(tmp_path / "e.csv")) == 3
    with pytest.raises(ValueError, match="predictions missing for 1 ids"):
        io.join_predictions(scored, preds.where("id <> '2'"))
    with pytest.raises(ValueError, match="unknown labels"):
        io.labelled(rows.withColumn("label", F.lit("odd")))


def test_agreement(spark):
    t = spark.createDataFrame([("a", "a", "u", "u"), ("a", "b", "u", "u"), ("b", "b", "u", "u"), ("b", "", "u", "")], "label_a string, label_b string, urgency_a string, urgency_b string")
    r = {x.field: x for x in M.agreement(t).collect()}
    assert r["label"].n == 3 and r["label"].percent_agreement == pytest.approx(2 / 3) and M.disagreements(t).count() == 1
