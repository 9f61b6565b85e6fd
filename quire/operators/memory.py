"""Translation memory: lookups, latest write wins, distinct misses, retries.

Texts are made distinct before a lookup, the memory is read through a latest-wins view and
only misses reach an engine. New rows are written before they are joined, so a task that is
run twice does not call an engine twice for a row that is already there.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx

COLUMNS = "engine string, params string, original_text string, translation string, seq long"
KEY = ("engine", "params", "original_text")
MAX_ENGINE_NAME = 20


def canonical(value: object) -> str:
    """One text for equal parameters: object keys sorted at every depth, lists as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_map(params: Column) -> Column:
    """The same for a map of strings."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def merged(params: Mapping, more: Mapping) -> dict:
    """Parameters with further ones, which win."""
    return {**params, **more}


def merged_map(params: Column, more: Column) -> Column:
    kept = F.map_filter(params, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(kept, more)


def latest(memory: DataFrame) -> DataFrame:
    """One row for each key: its last write."""
    return memory.groupBy(*KEY).agg(F.max_by("translation", "seq").alias("translation"), F.max("seq").alias("seq"))


def lookup(wanted: DataFrame, memory: DataFrame, engine: str, params: str, text: str = "text") -> DataFrame:
    """wanted with translation (null: a miss). Keys of other engines or parameters never match."""
    mine = latest(memory.where((F.col("engine") == engine) & (F.col("params") == params))).select(F.col("original_text").alias("__t"), "translation")
    return wanted.join(mine, F.col(text) == F.col("__t"), "left").drop("__t")


def misses(wanted: DataFrame, memory: DataFrame, engine: str, params: str, text: str = "text") -> DataFrame:
    """Distinct texts without a row in the memory."""
    mine = memory.where((F.col("engine") == engine) & (F.col("params") == params)).select(F.col("original_text").alias(text))
    return wanted.select(text).distinct().join(mine, text, "left_anti")


class Memory:
    """A memory in Parquet files under one path; writes append, ``compact`` keeps the last."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _there(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(COLUMNS).parquet(self.path) if self._there() else self.spark.createDataFrame([], COLUMNS)

    def next_seq(self) -> int:
        return (self.rows().agg(F.max("seq")).first()[0] or 0) + 1

    def append(self, rows: DataFrame, engine: str, params: str) -> None:
        """rows has original_text and translation."""
        if not engine or len(engine) >= MAX_ENGINE_NAME:
            raise ValueError(f"an engine's name has 1 to {MAX_ENGINE_NAME - 1} characters: {engine!r}")
        out = rows.select(F.lit(engine).alias("engine"), F.lit(params).alias("params"), "original_text", "translation", F.lit(self.next_seq()).cast("long").alias("seq"))
        out.write.mode("append").parquet(self.path)

    def put(self, engine: str, params: object, text: str, translation: str) -> None:
        self.append(self.spark.createDataFrame([(text, translation)], "original_text string, translation string"), engine, canonical(params))

    def get(self, engine: str, params: object, text: str) -> str | None:
        row = lookup(self.spark.createDataFrame([(text,)], "text string"), self.rows(), engine, canonical(params)).first()
        return row.translation

    def compact(self) -> None:
        """Rewrites the files with the last row of each key."""
        kept = f"{self.path}.compacting"
        latest(self.rows()).select("engine", "params", "original_text", "translation", "seq").write.mode("overwrite").parquet(kept)
        self.spark.read.schema(COLUMNS).parquet(kept).write.mode("overwrite").parquet(self.path)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(kept)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class Retry(Exception):
    """A failure that may pass: a rate limit, a timeout."""


class Refused(Exception):
    """A failure for good: the text will not be translated."""


@dataclass(frozen=True)
class RetryPolicy:
    """Bounded retries: for passing failures with growing waits, for others with a fixed one."""

    limited_attempts: int = 100
    least_wait: float = 1.0
    most_wait: float = 15.0
    other_attempts: int = 5
    other_wait: float = 1.0

    def call(self, function: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
        limited = other = 0
        while True:
            try:
                return function()
            except Refused:
                raise
            except Retry:
                limited += 1
                if limited >= self.limited_attempts:
                    raise
                sleep(min(self.most_wait, max(self.least_wait, 2.0 ** (limited - 1))))
            except Exception:
                other += 1
                if other >= self.other_attempts:
                    raise
                sleep(self.other_wait)


def first_success(models: Sequence[str], call: Callable[[str], str]) -> str:
    """Models in order until one answers."""
    said = []
    for model in models:
        try:
            return call(model)
        except Exception as failure:  # noqa: BLE001  any failure passes on to the next model
            said.append(f"{model}: {failure}")
    raise RuntimeError("all models failed: " + "; ".join(said))


@dataclass(frozen=True)
class Engine:
    """What translates: a name, key parameters, and a factory of text -> text for a worker."""

    name: str
    lang_in: str
    lang_out: str
    model: str = ""
    factory: Callable[[], Callable[[str], str]] = field(default=None)  # type: ignore[assignment]
    params: Mapping[str, object] = field(default_factory=dict)
    cacheable: bool = True
    retry: RetryPolicy = field(default_factory=RetryPolicy)

    @property
    def key(self) -> str:
        """Languages, model and whatever else changes an answer, the prompt included."""
        return canonical({"lang_in": self.lang_in, "lang_out": self.lang_out, "model": self.model, **self.params})


def pseudo(lang_out: str) -> Callable[[], Callable[[str], str]]:
    """A deterministic stand-in for an engine: the text behind its language."""
    return lambda: lambda text: f"[{lang_out}] {text}"


TRANSLATED = "text string, translation string, status string"


def call_engine(texts: DataFrame, engine: Engine, threads: int = 4) -> DataFrame:
    """text, translation, status of each row; a failure becomes a status, not a lost job.

    A worker makes one client and keeps ``threads`` calls going at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        client = engine.factory()

        def one(text: str) -> tuple[str, str | None, str]:
            try:
                return text, engine.retry.call(lambda: client(text)), "ok"
            except Refused as failure:
                return text, None, f"refused: {failure}"
            except Exception as failure:  # noqa: BLE001  kept as the row's status
                return text, None, f"failed: {failure}"

        def work(texts: list[str], places: Iterator[int], out: list) -> None:
            for k in places:  # threads take the next text from one iterator; no future a text
                out[k] = one(texts[k])

        with ThreadPoolExecutor(max(1, threads)) as pool:
            for batch in batches:
                texts, out = batch["text"].tolist(), [None] * len(batch)
                places = iter(range(len(texts)))
                for running in [pool.submit(work, texts, places, out) for _ in range(max(1, threads))]:
                    running.result()
                yield pd.DataFrame(out, columns=["text", "translation", "status"])

    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, long waits: tasks are not merged
    return texts.select("text").repartition(tasks, "text").mapInPandas(run, TRANSLATED)


def translate(paragraphs: DataFrame, engine: Engine, memory: Memory | DataFrame | None = None, ignore_cache: bool = False, threads: int = 4, text: str = "text") -> DataFrame:
    """paragraphs with translation, status and hit.

    Blank texts and lone marks keep their text. Others are looked up unless the memory is to
    be ignored; misses go to the engine once for each different text, and good answers are
    appended, also when the memory was ignored, so that they replace older ones. A memory
    given as a DataFrame is only read.
    """
    keep = memory is not None and engine.cacheable
    store = memory if keep and isinstance(memory, Memory) else None
    skip = tx.untranslatable(F.col(text))
    wanted = paragraphs.where(~skip).select(F.col(text).alias("text")).distinct()
    known = store.rows() if store else memory if keep else paragraphs.sparkSession.createDataFrame([], COLUMNS)
    asked = wanted if ignore_cache or not keep else misses(wanted, known, engine.name, engine.key)
    fresh = call_engine(asked, engine, threads)
    if store:
        done = f"{store.path}.answers-{store.next_seq()}"
        fresh.write.mode("overwrite").parquet(done)  # engines are asked here, once
        fresh = paragraphs.sparkSession.read.schema(TRANSLATED).parquet(done)
        store.append(fresh.where("status = 'ok'").select(F.col("text").alias("original_text"), "translation"), engine.name, engine.key)
    old = latest(known.where((F.col("engine") == engine.name) & (F.col("params") == engine.key))).select(F.col("original_text").alias("text"), "translation")
    answers = fresh.withColumn("hit", F.lit(False))
    if keep and not ignore_cache:
        answers = answers.unionByName(old.join(wanted, "text", "left_semi").select("text", "translation", F.lit("ok").alias("status"), F.lit(True).alias("hit")))
    answers = answers.select(F.col("text").alias("__t"), "translation", "status", "hit")
    joined = paragraphs.join(answers, (F.col(text) == F.col("__t")) & ~skip, "left").drop("__t")
    return joined.withColumn("translation", F.when(skip, F.col(text)).otherwise(F.col("translation"))).withColumn("status", F.when(skip, "skipped").otherwise(F.col("status"))).withColumn("hit", F.coalesce("hit", F.lit(False)))
