"""The one-pass automaton against the regular expression of each lexicon, and against a plain scanner."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meridex.functions import lexicon as L
from meridex.functions import rules
from meridex.functions import vocabulary as V
from meridex.functions.match import has_any, is_negated, negators, term_pattern
from meridex.functions.textfn import normalise, term

TERMS = [t for v in L.LEXICONS.values() for t in v]


def word(rng):
    x = rng.random()
    if x < 0.4:
        return rng.choice(["", *V.CLITICS]) * (rng.random() < 0.3) + rng.choice(TERMS) + rng.choice(["", *V.SUFFIXES]) * (rng.random() < 0.3)
    if x < 0.55:
        return rng.choice(V.NEGATORS)
    if x < 0.65:
        return rng.choice([*V.BREAKERS, "او"])
    if x < 0.78:
        return rng.choice(["3", "x", "|", "٣", "پ", ""]) + rng.choice(TERMS) + rng.choice(["3", "|", "٣", "پ.", ""])
    return rng.choice(["في", "السن", "كلمه", "ثم", "جدا", ".", "،", "|", "ولا", "7", "ok"])


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "no Arabic", "تورم", "ت" * 100_000, "تورم " * 20_000, *(" ".join(word(rng) for _ in range(rng.randrange(16))) for _ in range(10_000))]
    d = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(texts)], "id int, text string, _m string, lexicon int").repartition(8)
    return d.withColumn("n", normalise(F.col("text"), True)).cache()


def test_same_flags_as_regular_expressions(rows):
    got = dict(rows.where("length(n) < 10000").select("id", L.free_mask(F.col("n"))).collect())
    want = rows.where("length(n) < 10000").select("id", *[has_any(F.col("n"), terms) for terms in L.LEXICONS.values()]).collect()
    assert len(want) > 10_000 and sum(map(any, (r[1:] for r in want))) > 5000
    for r in want:
        assert got[r[0]] == sum(1 << k for k, x in enumerate(r[1:]) if x)


def test_spans_against_scanner(rows):
    """Places by each lexicon's pattern; negation by the tokens before, as a loop reads them."""
    patterns = {k: re.compile(term_pattern(v) + f"(?=(?P<whole>(?:{'|'.join(V.CLITICS)})?(?:{'|'.join(sorted({term(t) for t in v}, key=len, reverse=True))})(?:{'|'.join(V.SUFFIXES)})?(?![ء-ي])))") for k, v in L.LEXICONS.items()}
    wide = [n.split() for n in negators() if n != V.ADJACENT]

    def negated(before):
        t = before.split()
        if t[-1:] == [V.ADJACENT]:
            return True
        for k in range(4):
            between = t[len(t) - k :] if k else []
            head = t[: len(t) - k]
            if len(head) < len(t) - k or len(between) < k or set(between) & set(V.BREAKERS) or (k == 3 and V.OR not in between):
                continue
            if any(head[-len(n) :] == n for n in wide):
                return True
        return False

    few = rows.where("id between 7 and 2006")
    for r in few.select("n", L.spans(F.col("n")).alias("s")).collect():
        got = {(s.lexicon, s.start): (s.end, s.negated) for s in r.s}
        want = {}
        for k, p in patterns.items():
            for m in p.finditer(r.n):
                want[k, m.start()] = (m.end("whole"), negated(r.n[: m.start()]))
        assert got == want


def test_edges(rows):
    r = {x.id: x for x in rows.where("id < 7").select("id", L.free_mask(F.col("n")).alias("m"), F.size(L.spans(F.col("n"))).alias("k")).collect()}
    assert [r[i].m for i in (0, 1, 2, 3, 5)] == [0] * 5
    assert r[6].k == 20_000 * r[4].k and r[6].m == r[4].m > 0


def test_long_parts_without_arabic(spark):
    rng = random.Random(5)
    part = lambda: " ".join(rng.choice(["x", "|", "3", "the", "12.5", "پ"]) for _ in range(rng.choice([0, 2, 3, 7, 8, 9, 30, 450])))
    texts = [re.sub(" +", " ", " ".join(f"{part()} {word(rng)}{rng.choice(['', '3', '|x'])}" for _ in range(6))).strip() for _ in range(600)] + ["a " * 100_000 + "تورم"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, n string").repartition(8)
    got = dict(d.select("id", L.free_mask(F.col("n"))).collect())
    for r in d.where("id < 600").select("id", *[has_any(F.col("n"), terms) for terms in L.LEXICONS.values()]).collect():
        assert got[r[0]] == sum(1 << k for k, x in enumerate(r[1:]) if x)
    assert got[600] > 0


def test_one_pass_in_the_plan(rows):
    plan = rules.rule_engine(rows.select("id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" in plan and plan.count("RLIKE") < 8


def test_lexicons_of_ones_own(spark):
    d = spark.createDataFrame([("لا يوجد تورم شديد جدا بس الم قوي",)], "n string")
    own = {"a": ["تورم شديد جدا"], "b": ["قوي", "الم قوي"]}
    r = d.select(L.spans(F.col("n"), own).alias("s"), L.free_mask(F.col("n"), own).alias("m")).first()
    assert [tuple(x) for x in r.s] == [("a", 8, 21, True), ("b", 25, 32, False), ("b", 29, 32, False)] and r.m == 2
