"""Nearest-prototype suggestions over embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridex.functions import vocabulary as V

# Fixed value: tokens after which the encoder cuts a text.
MOST_TOKENS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v scaled to length 1, as torch does: a length below 1e-12 counts as that."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, clamped to [-1, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b)))


def centroids(protos: DataFrame) -> DataFrame:
    """label, centroid: the unit mean of a label's unit vectors. protos: label, embedding."""
    each = protos.select("label", F.posexplode(unit(F.col("embedding"))).alias("pos", "x"))
    mean = each.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    rows = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return rows.select("label", unit(F.transform("v", lambda s: s["x"])).alias("centroid"))


def suggest(df: DataFrame, protos: list[tuple[object, list[float]]], embedding: str = "embedding", min_score: float = V.MIN_SCORE, min_margin: float = V.MIN_MARGIN, unclear: object = V.UNCLEAR) -> DataFrame:
    """df with suggestion struct(label, score, second_label, second_score).

    protos: (label, centroid) in their order, which breaks ties; a handful of rows, kept in the plan as literals, so that
    rows are scored in place without a join.
    """
    kind = "string" if isinstance(protos[0][0], str) else "int"
    scored = F.array(*[
        F.struct((-cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in c]))).alias("neg"), F.lit(k).alias("ord"), F.lit(label).cast(kind).alias("label"))
        for k, (label, c) in enumerate(protos)])
    x = df.withColumn("_s", F.array_sort(scored))
    best, second = F.get("_s", 0), F.get("_s", 1)
    score, runner = -best["neg"], -second["neg"]
    low = (score < min_score) | F.coalesce(score - runner < min_margin, F.lit(False))
    return x.withColumn("suggestion", F.struct(
        F.when(low, F.lit(unclear).cast(kind)).otherwise(best["label"]).alias("label"), score.alias("score"), second["label"].alias("second_label"), runner.alias("second_score"))).drop("_s")


def masked_mean(vectors: Column, mask: Column, most: int = MOST_TOKENS) -> Column:
    """The unit vector of a row's token vectors (array of arrays): the mean of the first `most` that the mask has, scaled to length 1.

    As the encoder does it: a count below 1e-9 counts as that, so a row whose every token is masked gives zeros.
    """
    v, m = F.slice(vectors, 1, most), F.slice(mask, 1, most)
    kept = F.zip_with(v, m, lambda x, k: F.transform(x, lambda y: y.cast("double") * k))
    total = F.aggregate(F.slice(kept, 2, most), F.element_at(kept, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    count = F.greatest(F.aggregate(m, F.lit(0.0), lambda a, k: a + k), F.lit(1e-9))
    return F.when(F.size(kept) > 0, unit(F.transform(total, lambda x: x / count)))


def pool_tokens(tokens: DataFrame, key: str, pos: str = "pos", mask: str = "mask", embedding: str = "embedding", most: int = MOST_TOKENS) -> DataFrame:
    """key, embedding: the same over rows, one for each token; tokens at place `most` or later are cut off.

    Sums are kept by key and dimension in each task before they are shuffled, so a sequence of any length is never in one place.
    Vectors of one key have one length; null keys are a key like any other, a null mask hides its token, as a null vector does.
    """
    x = tokens.where((F.col(pos) < most) & F.col(embedding).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(mask), F.lit(0)).cast("double").alias("m"), F.posexplode(embedding).alias("dim", "x"))
    mean = x.groupBy("key", "dim").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("x"))
    rows = mean.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return rows.select(F.col("key").alias(key), unit(F.transform("v", lambda s: s["x"])).alias("embedding"))


_models: dict = {}


def encode(df: DataFrame, load: Callable[[], Callable], text: str = "text", most: int = MOST_TOKENS) -> DataFrame:
    """df with embedding, by a model that `load` gives once in each Python worker.

    The model takes a list of texts and the number of tokens after which they are cut, and gives for each text its token vectors
    (an array [tokens, dimensions]) and mask; the pooling is done here, as in masked_mean. A null text is an empty one.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    name = uuid.uuid4().hex  # functions are made anew in each task, the name is not

    def run(batches):
        import numpy as np
        import pyarrow as pa

        if name not in _models:
            _models.clear()
            _models[name] = load()
        model = _models[name]
        for b in batches:
            vectors = []
            for v, m in model([t or "" for t in b.column(text).to_pylist()], most):
                v, m = np.asarray(v, float)[:most], np.asarray(m, float)[:most]
                mean = (v * m[:, None]).sum(0) / max(m.sum(), 1e-9)
                vectors.append((mean / max(np.sqrt((mean * mean).sum()), 1e-12)).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return df.mapInArrow(run, schema)
