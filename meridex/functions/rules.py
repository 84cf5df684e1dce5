"""Rule labels, red flags, urgency, severity, the hybrid decision and messages, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridex.functions import vocabulary as V
from meridex.functions.lexicon import free_mask, holds
from meridex.functions.textfn import normalise, word_count


def classify(c: Column, free: Column | None = None) -> Column:
    """struct(label, severity) of a normal form with boundaries; the first rule that holds decides.

    free: free_mask(c) where it is at hand, so that several rules share one pass over the text; so below.
    """
    mask = free_mask(c) if free is None else free
    f = {k: holds(mask, f"rule.{k}") for k in V.RULES}
    pain, night, persistent, throbbing, severe = f["pain"], *(f["pain"] & f[k] for k in ("night", "persistent", "throbbing", "severe"))
    transient = f["transient"] & ~f["persistent"]

    def says(label: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(V.SEVERITY_OF[label]).alias("severity"))

    return (
        F.when(F.coalesce(F.trim(c), F.lit("")) == "", says(V.UNCLEAR))
        .when(f["pus"] | f["face_swelling"] | (f["swelling"] & (pain | severe | persistent | f["fever"])), says(V.ABSCESS))
        .when((persistent & (night | throbbing | severe)) | (night & severe), says(V.IRREVERSIBLE))
        .when(f["stimulus"] & transient, says(V.REVERSIBLE))
        .when(f["chewing"] & (pain | f["cavity"] | f["tooth"]), says(V.DEEP))
        .when(f["bleeding"] & (f["gum"] | f["gum_context"]), says(V.GINGIVITIS))
        .when(f["stimulus"] & f["surface_stimulus"] & ~persistent & ~night, says(V.SURFACE))
        .otherwise(says(V.UNCLEAR))
    )


def red_flags(c: Column, free: Column | None = None) -> Column:
    """Codes of the red flags in c, in their fixed order."""
    mask = free_mask(c) if free is None else free
    flags = [F.when(holds(mask, f"flag.{code}"), F.lit(code)) for code in V.RED_FLAGS]
    feverish = holds(mask, "urgency.fever") & (holds(mask, "urgency.swelling") | holds(mask, "urgency.pus"))
    flags.append(F.when(feverish, F.lit("fever_with_swelling_or_pus")))
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def urgency(label: Column, severity: Column, c: Column, flags: Column | None = None, free: Column | None = None) -> Column:
    mask = free_mask(c) if free is None else free
    f = {k: holds(mask, f"urgency.{k}") for k in V.URGENCY}
    unrelieved, night = f["pain"] & f["unrelieved"], f["pain"] & f["night"]
    urgent = (label.isin(V.CRITICAL) | (F.size(red_flags(c, mask) if flags is None else flags) > 0) | f["pus"]
              | (f["swelling"] & (f["pain"] | unrelieved)) | ((severity == "High") & night & unrelieved))
    return F.when(urgent, V.URGENT).otherwise(V.NON_URGENT)


def final_severity(label: Column, urg: Column) -> Column:
    by = F.create_map(*[F.lit(x) for kv in V.SEVERITY_OF.items() for x in kv])
    return F.when(urg == V.URGENT, "High").otherwise(F.coalesce(F.try_element_at(by, label), F.lit("Low")))


def hybrid_decision(rule: Column, model: Column, upgrades: dict[str, list[str]] | None = None, critical: list[str] | None = None, unclear: str = V.UNCLEAR) -> Column:
    """The rule's label unless the model may refine it."""
    ups = V.SAFE_UPGRADES if upgrades is None else upgrades
    allowed = F.lit(False)
    for label, to in ups.items():
        allowed = allowed | ((rule == label) & (model.isin(to) if to else F.lit(False)))
    return F.when(rule.isin(V.CRITICAL if critical is None else critical) | (model == unclear), rule).when((rule == unclear) | allowed, model).otherwise(rule)


def confidence(model: Column, score: Column, unclear: str = V.UNCLEAR) -> Column:
    return F.least(F.lit(0.9), F.greatest(F.lit(0.0), F.when(model == unclear, 0.5).otherwise(score)))


def confidence_level(conf: Column) -> Column:
    return F.when(conf >= 0.75, "high").when(conf >= 0.5, "medium").otherwise("low")


def explanation(severity: Column, urg: Column) -> Column:
    return F.when(urg == V.URGENT, V.EXPLAIN_URGENT).when(severity == "Moderate", V.EXPLAIN_MODERATE).when(severity == "Low", V.EXPLAIN_LOW).otherwise(V.EXPLAIN_ELSE)


def interpret_kappa(k: Column) -> Column:
    return (F.when(k >= 0.80, "almost perfect").when(k >= 0.70, "good - acceptable for a gold set")
            .when(k >= 0.60, "moderate - tighten the guidelines").otherwise("poor - do not use as ground truth"))


def rule_engine(df: DataFrame, text: str = "text") -> DataFrame:
    """df with label, severity, urgency, red_flags and a null confidence, by rules alone."""
    n, m = F.col("_n"), F.col("_m")
    out = df.withColumn("_n", normalise(F.col(text), boundaries=True)).withColumn("_m", free_mask(n)).withColumn("_c", classify(n, m)).withColumn("red_flags", red_flags(n, m))
    out = out.withColumn("label", F.col("_c.label")).withColumn("urgency", urgency(F.col("label"), F.col("_c.severity"), n, F.col("red_flags"), m))
    return out.withColumn("severity", final_severity(F.col("label"), F.col("urgency"))).withColumn("confidence", F.lit(None).cast("double")).drop("_n", "_m", "_c")


def analyse(df: DataFrame, text: str = "text", suggestion: str = "suggestion") -> DataFrame:
    """The full result of each row; df has a column struct(label, score, second_label, second_score) from the encoder.

    The time taken is left out, as it is not a function of the input.
    """
    s = F.col(suggestion)
    x = df.withColumn("_plain", normalise(F.col(text))).withColumn("_n", normalise(F.col(text), boundaries=True))
    n, m = F.col("_n"), F.col("_m")
    x = x.withColumn("_m", free_mask(n)).withColumn("_r", classify(n, m)).withColumn("_f", red_flags(n, m))
    x = x.withColumn("_d", hybrid_decision(F.col("_r.label"), s["label"]))
    x = x.withColumn("_u", urgency(F.col("_d"), F.col("_r.severity"), n, F.col("_f"), m)).withColumn("_s", final_severity(F.col("_d"), F.col("_u")))
    x = x.withColumn("_c", confidence(s["label"], s["score"]))
    said = lambda label, c: F.struct(label.alias("label"), F.round(c, 3).alias("confidence"))
    second = F.when(s["second_label"].isNotNull(), said(s["second_label"], F.coalesce(s["second_score"], F.lit(0.0))))
    keep = [F.col(c) for c in df.columns if c not in (suggestion,)]
    return x.select(
        *keep, F.col("_plain").alias("clean_text"), F.col("_r.label").alias("rule_diagnosis"), F.col("_s").alias("severity"), F.lower("_s").alias("severity_level"),
        s["label"].alias("arabert_diagnosis"), F.round(s["score"], 3).alias("arabert_score"), s["second_label"].alias("arabert_second"), F.round(s["second_score"], 3).alias("arabert_second_score"),
        F.col("_d").alias("diagnosis"), F.col("_u").alias("urgency"), F.col("_f").alias("red_flags"), F.round("_c", 3).alias("confidence"), confidence_level(F.col("_c")).alias("confidence_level"),
        F.lit(V.MODEL_VERSION).alias("model_version"), F.col("_plain").alias("normalized_text"), explanation(F.col("_s"), F.col("_u")).alias("patient_explanation"),
        F.filter(F.array(said(F.col("_d"), F.col("_c")), second), lambda z: z.isNotNull()).alias("suspected_conditions"),
        F.struct(word_count(F.col("_plain")).alias("tokens_length")).alias("metadata"),
    )


def response(result: DataFrame, kind: int) -> DataFrame:
    """One of the three response contracts over rows of analyse()."""
    if kind == 1:
        return result.select(F.col("clean_text").alias("text"), "diagnosis", F.col("severity_level").alias("severity"), "urgency", "red_flags", "rule_diagnosis", "arabert_diagnosis", "arabert_score",
                             "arabert_second", "arabert_second_score", "patient_explanation", "model_version", "confidence", "confidence_level", "metadata")
    if kind == 2:
        model = F.struct(F.col("arabert_diagnosis").alias("label"), F.col("arabert_score").alias("score"), F.col("arabert_second").alias("second"), F.col("arabert_second_score").alias("second_score"))
        return result.select(F.col("diagnosis").alias("diagnosis_label"), F.lit("medium").alias("confidence_level"), F.col("severity").alias("severity_level"), F.col("urgency").alias("urgency_level"),
                             "patient_explanation", F.lit(None).cast("string").alias("recommendations"), F.struct("rule_diagnosis", model.alias("arabert"), "model_version", "confidence", "red_flags").alias("metadata"))
    case = F.col("case_id") if "case_id" in result.columns else F.lit(None).cast("string")
    named = F.transform("suspected_conditions", lambda z: F.struct(z["label"].alias("name"), z["confidence"].alias("confidence")))
    return result.select(case.alias("case_id"), named.alias("suspected_conditions"), F.col("severity_level").alias("severity"), "model_version", F.col("diagnosis").alias("primary_condition"),
                         "confidence_level", "normalized_text", "metadata", F.lit(V.NOTE).alias("note"))


def health(spark) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(True).alias("model_loaded"), F.lit(V.MODEL_VERSION).alias("model_version"))
