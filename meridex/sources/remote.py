"""A remote engine behind a read-through cache.

Texts are sent once each, by hash, from many tasks with a bounded number of requests under way in each, and again with a growing
pause where the service fails for a while. What came back is kept by hash, so a rerun sends what is missing only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A service's answer, as it is kept.
ANSWER = T.StructType([T.StructField("label", T.StringType()), T.StructField("urgency", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("red_flags", T.ArrayType(T.StringType()))])

# The service's route, and the fields of its answer with what they are called here.
ROUTE = "/api/analyze-text"
FIELDS = {"diagnosis": "label", "urgency": "urgency", "confidence": "confidence", "red_flags": "red_flags"}
REQUIRED = ["label", "urgency"]


class ResultCache:
    """Results by key, as generations of Parquet in a folder; a generation is written aside and then renamed into place.

    A reader sees whole generations alone, and two writers do not disturb each other; a key that both wrote has the least result.
    """

    def __init__(self, spark: SparkSession, root: str, result: T.DataType):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("result", result)])

    def _path(self, name: str):
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return jvm, jvm.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[str]:
        at, fs = self._path("")
        return sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("gen-")) if fs.exists(at) else []

    def read(self) -> DataFrame:
        """key, result of all that is kept, a row for each key."""
        found = self.generations()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*found)
        return rows.groupBy("key").agg(F.min("result").alias("result")) if len(found) > 1 else rows

    def fill(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """key, result of every key of `wanted` (key and what compute needs); compute(misses) gives key and result of those not kept yet.

        Keys that come many times are computed once; null keys are left out. Results are dealt by hash of their key before they are written.
        """
        once = wanted.where("key is not null").dropDuplicates(["key"])
        misses = once.join(self.read().select("key"), "key", "left_anti")
        name = uuid.uuid4().hex
        aside = f"{self.root}/_{name}"
        compute(misses).select("key", "result").repartition("key").write.parquet(aside)
        new, fs = self._path(f"_{name}")
        if self.spark.read.schema(self.schema).parquet(aside).isEmpty():
            fs.delete(new, True)
        elif not fs.rename(new, self._path(f"gen-{name}")[0]):
            raise OSError(f"could not put {aside} into place")
        return once.select("key").join(self.read(), "key", "left")


class ServiceError(RuntimeError):
    """The service did not answer a text, or not with what is needed."""


def with_retries(call: Callable[[str], dict], tries: int = 4, pause: float = 0.5) -> Callable[[str], dict]:
    """call, again after a pause that doubles, where it raises; the last error is raised on."""

    def again(text: str) -> dict:
        for k in range(tries):
            try:
                return call(text)
            except Exception as e:
                if k == tries - 1:
                    raise ServiceError(f"no answer after {tries} tries: {e}") from e
                time.sleep(pause * 2**k)
        raise AssertionError("not reached")

    return again


def http_service(base: str, timeout: float = 90.0) -> Callable[[str], dict]:
    """A client of the service at `base`: text -> answer in the names of ANSWER."""
    import urllib.request

    url = base.rstrip("/") + ROUTE

    def call(text: str) -> dict:
        asked = urllib.request.Request(url, json.dumps({"text": text}, ensure_ascii=False).encode(), {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(asked, timeout=timeout) as reply:
            said = json.load(reply)
        answer = {own: said.get(theirs) for theirs, own in FIELDS.items()}
        if lost := [k for k in REQUIRED if answer[k] is None]:
            raise ServiceError(f"an answer without {lost}")
        return answer

    return call


def _ask(call: Callable[[str], dict], at_once: int, window: int):
    result = pa.struct([("label", pa.string()), ("urgency", pa.string()), ("confidence", pa.float64()), ("red_flags", pa.list_(pa.string()))])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), window):
                yield b.slice(i, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in windows(batches):  # a window's texts are under way together, no more
                answers = [{"label": a["label"], "urgency": a["urgency"], "confidence": a.get("confidence"), "red_flags": a.get("red_flags") or []} for a in pool.map(call, b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(answers, result)], names=["key", "result"])

    return run


def remote_engine(df: DataFrame, call: Callable[[str], dict], cache: str, text: str = "text", at_once: int = 4, tasks: int | None = None, tries: int = 4, pause: float = 0.5) -> DataFrame:
    """df with pred_label, pred_urgency, confidence, pred_flags of a service.

    cache: a folder that all executors share; texts whose answers it holds are not sent. Equal texts are sent once. At most
    `tasks` times `at_once` requests are under way (tasks: by default one for each shuffle partition). A null text is sent as an empty one. Raises
    if a text has no answer after `tries` tries; what other tasks were told by then is lost with their generation, never half kept.
    """
    keyed = df.withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    store = ResultCache(df.sparkSession, cache, ANSWER)
    asked = _ask(with_retries(call, tries, pause), at_once, 8 * at_once)
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = keyed.select(F.col("_key").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kept = store.fill(wanted, lambda misses: misses.select("key", "text").repartition(n, "key").mapInArrow(asked, store.schema))
    found = keyed.join(kept.select(F.col("key").alias("_key"), F.col("result").alias("_answer")), "_key", "left")
    named = {"label": "pred_label", "urgency": "pred_urgency", "confidence": "confidence", "red_flags": "pred_flags"}
    return found.select(*[c for c in df.columns if c not in named.values()], *[F.col(f"_answer.{k}").alias(v) for k, v in named.items()])


def content_key(content, model: str, language: str):
    """The key of a file's result: the hash of its content with the model and the language; null without content."""
    return F.concat(F.sha2(content, 256), F.lit(f"_{model}_{language}"))


def cached_results(files: DataFrame, cache: str, model: str, language: str, compute: Callable[[DataFrame], DataFrame], result: T.DataType = T.StringType()) -> DataFrame:
    """files (path, content) with key and result: the kept one, or the one that compute(key, content) gives now and that is kept then."""
    keyed = files.withColumn("key", content_key(F.col("content"), model, language))
    kept = ResultCache(files.sparkSession, cache, result).fill(keyed.select("key", "content"), compute)
    return keyed.select("path", "key").join(kept, "key", "left").select("path", "key", "result")
