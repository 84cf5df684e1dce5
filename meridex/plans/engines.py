"""Engines of the evaluation run behind one interface: rows (row_id, text, ...) -> rows with pred_label, pred_urgency, confidence, pred_flags."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridex.functions import vector
from meridex.functions import vocabulary as V
from meridex.functions.rules import analyse, rule_engine
from meridex.sources import remote

PREDICTED = ["pred_label", "pred_urgency", "confidence", "pred_flags"]


@dataclass
class Options:
    """What engines may need beside the rows."""

    url: str | None = None  # of the service
    cache: str | None = None  # folder of kept answers
    prototypes: DataFrame | None = None  # label, embedding, for the full engine
    load: Callable[[], Callable] | None = None  # gives the encoder's model once a worker; None: rows have an embedding


ENGINES: dict[str, Callable[[DataFrame, Options], DataFrame]] = {}


def engine(name: str):
    """Registers an engine under a name that the command line takes."""

    def add(f):
        ENGINES[name] = f
        return f

    return add


def predict(name: str, rows: DataFrame, options: Options | None = None) -> DataFrame:
    """rows with the predictions of the engine of this name, each row once."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine '{name}': {sorted(ENGINES)}")
    return ENGINES[name](rows, options or Options())


@engine("rules")
def by_rules(rows: DataFrame, options: Options) -> DataFrame:
    """Rules alone; no confidence. Labels are added in place, without a join."""
    own = rows.select(F.struct("*").alias("_row"), F.col("text"))
    r = rule_engine(own)
    return r.select("_row.*", F.col("label").alias("pred_label"), F.col("urgency").alias("pred_urgency"), "confidence", F.col("red_flags").alias("pred_flags"))


def vectors(c: DataFrame, name: str = "embedding") -> DataFrame:
    """c with a column of vectors, which a CSV file holds as JSON arrays."""
    return c.withColumn(name, F.from_json(name, "array<double>")) if dict(c.dtypes)[name] == "string" else c


def encoded_prototypes(rows: DataFrame, load: Callable[[], Callable]) -> DataFrame:
    """label, embedding of the sentences that stand for each label."""
    said = rows.sparkSession.createDataFrame([(label, text) for label, texts in V.PROTOTYPES.items() for text in texts], "label string, text string")
    return vector.encode(said, load).select("label", "embedding")


@engine("full")
def in_full(rows: DataFrame, options: Options) -> DataFrame:
    """Rules refined by the nearest prototypes of a text's vector, with confidence.

    Vectors are the rows' column `embedding`, or the encoder's; prototypes are given, or the encoder's of the known sentences. A
    row without a vector is left to the rules: its model label is the unclear one.
    """
    if options.load is None and "embedding" not in rows.columns:
        raise ValueError("the full engine needs a column `embedding` or an encoder")
    if options.prototypes is None and options.load is None:
        raise ValueError("the full engine needs prototypes or an encoder")
    held = rows.select(F.struct("*").alias("_row"), F.col("text"), *([F.col("embedding")] if options.load is None else []))
    x = vectors(held) if options.load is None else vector.encode(held, options.load)
    protos = encoded_prototypes(rows, options.load) if options.prototypes is None else vectors(options.prototypes)
    place = {label: k for k, label in enumerate(V.LABELS)}
    cents = sorted(((r.label, list(r.centroid)) for r in vector.centroids(protos).collect()), key=lambda c: place.get(c[0], len(place)))  # a row per label
    said = vector.suggest(x, cents)
    none = F.struct(F.lit(V.UNCLEAR).alias("label"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("second_label"), F.lit(None).cast("double").alias("second_score"))
    said = said.withColumn("suggestion", F.when(F.col("embedding").isNull(), none).otherwise(F.col("suggestion"))).select("_row", "text", "suggestion")
    r = analyse(said)
    return r.select("_row.*", F.col("diagnosis").alias("pred_label"), F.col("urgency").alias("pred_urgency"), "confidence", F.col("red_flags").alias("pred_flags"))


@engine("api")
def by_service(rows: DataFrame, options: Options) -> DataFrame:
    """A service's answers, kept in the cache folder."""
    if not options.url:
        raise ValueError("--api-url is required with --engine api")
    if not options.cache:
        raise ValueError("the service's answers need a cache folder that all executors share")
    return remote.remote_engine(rows, remote.http_service(options.url), options.cache)


def loader(spec: str) -> Callable[[], Callable]:
    """`module:function` of a function that gives an encoder's model."""
    module, _, name = spec.partition(":")

    def load() -> Callable:
        return getattr(importlib.import_module(module), name)()

    return load
