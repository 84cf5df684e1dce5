"""An extension beyond the reference: the rule engine over a stream of texts. It is stateless, so any source will do."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meridex.functions.rules import rule_engine


def triage_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with label, severity, urgency, red_flags and confidence."""
    return rule_engine(stream, text)
