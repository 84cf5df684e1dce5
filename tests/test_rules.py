from golden import CASES
from pyspark.sql import functions as F

from meridex.functions import rules, textfn
from meridex.functions import vocabulary as V
from meridex.functions.match import has_any, is_negated, negators


def values(spark, texts, *cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").orderBy("id").select(*cols)
    return [tuple(r) for r in df.collect()]


def test_golden_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, text string")
    got = {r.id: r for r in rules.rule_engine(rows).collect()}
    assert len(CASES) == 73
    for i, (text, label, urgency) in enumerate(CASES):
        assert (got[i].label, got[i].urgency) == (label, urgency), text
        assert urgency != V.URGENT or got[i].severity == "High"


def test_normal_form(spark):
    n = textfn.normalise(F.col("text"))
    got = values(spark, ["ألم", "يوجعني", "ضرس", "قدم", "بالدم", "اللثة،  تنزف!!", "", None, "A  b.C"], n)
    assert [g[0] for g in got] == ["الم", "الم", "سن", "قدم", "بالنزيف", "اللثه نزيف", "", "", "a b c"]


def test_negators():
    assert len(negators()) == 47


def scanner(text: str, term: str) -> bool:
    """Plain restatement: some whole-word occurrence of term without a negator in scope."""
    neg = [tuple(n.split()) for n in negators()]
    toks = text.split()
    for i, tok in enumerate(toks):
        if tok != term:
            continue
        before, hit = toks[:i], False
        for gap in range(4):
            between = before[len(before) - gap :]
            if set(between) & set(V.BREAKERS) or (gap == 3 and V.OR not in between):
                continue
            head = before[: len(before) - gap]
            hit |= any(tuple(head[-len(n) :]) == n and (n != ("ولا",) or gap == 0) for n in neg)
        if not hit:
            return True
    return False


def test_scope_against_scanner(spark):
    import random

    rng = random.Random(3)
    words = ["تورم", "الم", "في", "او", "بس", "|", "بدون", "ما", "لا", "يوجد", "ولا", "غير", "ندم"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(400)]
    got = values(spark, texts, "text", has_any(F.col("text"), ["تورم"]))
    assert [(t, scanner(t, "تورم")) for t in texts] == got


def test_negation_needs_a_negator(spark):
    assert values(spark, ["", "بدون ", "ندم "], is_negated(F.col("text"))) == [(False,), (True,), (False,)]


def test_input_checks(spark):
    got = values(spark, ["ab", "12345", "tooth pain", "ألم في السن", None], textfn.reject_reason(F.col("text")))
    assert [g[0] for g in got] == ["too short", "numeric only", "not Arabic", None, "too short"]


def test_responses(spark):
    t = spark.createDataFrame([("ألم شديد مستمر", (V.DEEP, 0.8, V.ABSCESS, 0.5))], "text string, suggestion struct<label:string,score:double,second_label:string,second_score:double>")
    r = rules.analyse(t)
    assert rules.response(r, 1).first().severity == "high"
    assert rules.response(r, 2).first().confidence_level == "medium"
    assert [c.name for c in rules.response(r, 3).first().suspected_conditions] == [V.IRREVERSIBLE, V.ABSCESS]


def test_stream(spark, tmp_path):
    from meridex.streaming.triage import triage_stream

    spark.createDataFrame([("تورم الوجه وألم",)], "text string").write.mode("overwrite").json(str(tmp_path / "in"))
    q = triage_stream(spark.readStream.schema("text string").json(str(tmp_path / "in"))).writeStream.format("memory").queryName("triage").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.label for r in spark.table("triage").collect()] == [V.ABSCESS]


def test_flags_of_known_texts(spark):
    known = {"عندي حرارة": [], "حرارة وتورم في الخد": ["fever_with_swelling_or_pus"], "ما في صعوبة في البلع": [], "صعوبة في البلع وألم في السن": ["dysphagia"], "لا أستطيع فتح فمي بعد قلع الضرس": ["trismus"],
             "نزيف لا يتوقف بعد خلع السن": ["uncontrolled_bleeding"], "سقطت وانكسر السن": ["trauma"], "تورم الوجه وضيق التنفس": ["breathing_difficulty", "spreading_facial_swelling"]}
    assert dict(values(spark, known, "text", rules.red_flags(textfn.normalise(F.col("text"), True)))) == known


def test_urgency_of_known_rows(spark):
    known = [(V.UNCLEAR, "High", "الم بالليل مستمر", V.URGENT), (V.UNCLEAR, "Low", "الم بالليل مستمر", V.NON_URGENT), (V.ABSCESS, "Low", "", V.URGENT), (V.DEEP, "Moderate", "تورم مع الم", V.URGENT),
             (V.DEEP, "Moderate", "بدون تورم مع الم", V.NON_URGENT), (V.GINGIVITIS, "Low", "قيح", V.URGENT), (V.SURFACE, "Low", "بارد", V.NON_URGENT)]
    t = spark.createDataFrame(known, "label string, severity string, text string, want string")
    assert all(r.want == r.got for r in t.select("want", rules.urgency(F.col("label"), F.col("severity"), F.col("text")).alias("got")).collect())


def test_matches_and_scopes_of_known_texts(spark):
    found = {"بدون تورم ولا قيح": False, "عندي تورم": True, "ما في تورم بس تورم شديد": True, "لا يوجد الم شديد او تورم": False, "لا يوجد الم في السن تورم": True, "بدون الم | تورم": True, "والتورم": True, "قدم": False}
    assert dict(values(spark, found, "text", has_any(F.col("text"), V.RULES["swelling"]))) == found
    scope = {"بدون ": True, "بدون الم ": True, "بدون الم في ": True, "بدون الم في السن ": False, "بدون الم تلقائي او ": True, "بدون الم تلقائي في او ": False, "ولا ": True, "ولا الم ": False, "بدون الم بس ": False,
             "ما في ": True, "وما في ": True, "ما اعاني من ": True, "مو | ": False}
    assert dict(values(spark, scope, "text", is_negated(F.col("text")))) == scope


def test_analysis_of_known_rows(spark):
    rows = [("ألم شديد مستمر يوقظني من النوم", (V.DEEP, 0.8, V.ABSCESS, 0.5), 2, V.IRREVERSIBLE, V.IRREVERSIBLE, "high"), ("مرحبا", (V.DEEP, 0.6, None, None), 1, V.UNCLEAR, V.DEEP, "medium"),
            ("حساسية خفيفة من الحلو", (V.UNCLEAR, 0.4, V.DEEP, 0.39), 2, V.SURFACE, V.SURFACE, "medium"), ("حساسية خفيفة من الحلو", (V.REVERSIBLE, 0.95, V.DEEP, 0.3), 2, V.SURFACE, V.REVERSIBLE, "high")]
    t = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "id int, text string, suggestion struct<label:string,score:double,second_label:string,second_score:double>")
    got = rules.analyse(t).orderBy("id").select(F.size("suspected_conditions"), "rule_diagnosis", "diagnosis", "confidence_level").collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]
