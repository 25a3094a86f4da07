"""Stores: records by template, checkpoints of partial results, embeddings in several formats, JSON and text reports."""

from __future__ import annotations

import json
import signal
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quilate.sources import arrays
from quilate.sources.scratch import exists, removed
from quilate.sources.tables import wide_to_vectors


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; cells may hold line feeds and quotes."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# records of messages, responses and parses, by template


def record_path(template_path: str) -> str:
    """Where the record of a template file lies: ``rendered`` beside it, under the template's name."""
    folder, _, name = template_path.rpartition("/")
    if not name.endswith(".tmplt"):
        raise ValueError(f"{template_path} isn't a template file (.tmplt)")
    return f"{folder or '.'}/rendered/{name.removesuffix('.tmplt')}"


def save_record(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a record (messages, responses, parses), each as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_record(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = ("messages", "responses", "parses")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names if exists(spark, f"{path}/{n}")}


def load_records(spark: SparkSession, folder: str, templates: list[str]) -> DataFrame:
    """All records of a folder as one wide table; missing tables and strings become empty."""
    from quilate.operators.enrich import merged

    out = None
    for t in templates:
        r = load_record(spark, f"{folder}/{t}")
        one = merged(r["messages"], r["responses"], r.get("parses")).withColumn("template", F.lit(t))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(folder)
    return out


def rows_of(df: DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, a partition at a time; for the edge of a program only."""
    return (r.asDict() for r in df.toLocalIterator())


# partial results


class Checkpoint:
    """Partial results of a long job: parts are appended, found again, and removed at the end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, part: DataFrame) -> None:
        part.write.mode("append").parquet(self.path)

    def load(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if exists(self.spark, self.path) else None

    def pending(self, items: DataFrame, key: str) -> DataFrame:
        """Items without a result so far."""
        done = self.load()
        return items if done is None else items.join(done.select(key).distinct(), key, "left_anti")

    def clean(self) -> None:
        removed(self.spark, self.path)


class Interrupted(RuntimeError):
    """A job was stopped by a signal; finished parts are saved."""


@contextmanager
def stoppable(spark: SparkSession, signals: tuple[signal.Signals, ...] = (signal.SIGINT, signal.SIGTERM)) -> Iterator[None]:
    """Inside the block a signal cancels the block's Spark jobs, with their tasks, and ``Interrupted`` is raised.

    The jobs form a group of their own, so other threads' jobs go on. Outside the main
    thread, where handlers can't be set, the block runs as it is.
    """
    if threading.current_thread() is not threading.main_thread():
        yield
        return
    context, group, caught = spark.sparkContext, f"stoppable-{uuid.uuid4().hex}", []

    def stop(number: int, _: object) -> None:
        caught.append(signal.Signals(number).name)
        # by a thread of its own, as this one may wait for the JVM's answer
        threading.Thread(target=context.cancelJobGroup, args=(group,)).start()

    before = {s: signal.signal(s, stop) for s in signals}
    context.setJobGroup(group, "stoppable", interruptOnCancel=True)
    try:
        yield
    except Exception as e:
        if caught:
            raise Interrupted(caught[0]) from e
        raise
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
        for s, handler in before.items():
            signal.signal(s, handler)
    if caught:
        raise Interrupted(caught[0])


def resumed(items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], store: Checkpoint, resume: bool = True, parts: int = 1) -> DataFrame:
    """Results of all items: those of a stopped run are kept, the rest is worked on in ``parts`` that each are saved.

    Items fall into parts by a hash of their key, so that a stop loses one part at most.
    A signal to stop cancels the part at work and raises ``Interrupted``; called again,
    the job goes on with what isn't saved.
    """
    if not resume:
        store.clean()
    with stoppable(store.spark):
        for k in range(parts):
            own = items if parts == 1 else items.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
            store.append(work(store.pending(own, key)))
    found = store.load()
    assert found is not None
    return found


def written_once(df: DataFrame, path: str) -> DataFrame:
    """Results of calls that must not be made twice: written, then read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# embeddings


def save_embeddings(df: DataFrame, path: str, key: str = "responseId", vector: str = "embedding", formats: tuple[str, ...] = ("parquet",)) -> None:
    """``parquet``: rows of key and vector. ``npy`` and ``pkl``: files of arrays, or of dictionaries of ids and arrays (see ``arrays``).

    Files are written by the tasks through the shared file system, never gathered on the driver.
    """
    rows = df.select(key, F.col(vector).cast("array<float>").alias(vector))
    if rows.schema[key].dataType.simpleString() in ("int", "smallint", "tinyint"):
        rows = rows.withColumn(key, F.col(key).cast("bigint"))
    for kind in formats:
        if kind == "parquet":
            rows.write.mode("overwrite").parquet(f"{path}/parquet")
        else:
            arrays.registered(df.sparkSession)
            rows.write.format("embedding_files").option("kind", kind).mode("overwrite").save(f"{path}/{kind}")
    meta = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dimensions"))
    meta.select("*", F.lit(",".join(formats)).alias("formats")).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_embeddings(spark: SparkSession, path: str, key: str = "responseId", kind: str = "parquet", key_type: str = "string", vector: str = "embedding") -> DataFrame:
    """Key and vector; a table with a column per dimension becomes one of vectors. ``npy`` and ``pkl`` read files of arrays."""
    if kind in ("npy", "pkl"):
        at = f"{path}/{kind}" if exists(spark, f"{path}/{kind}") else path
        return arrays.registered(spark).read.format("embedding_files").options(kind=kind, key=key, type=key_type, vector=vector).load(at)
    df = spark.read.parquet(f"{path}/parquet" if exists(spark, f"{path}/parquet") else path)
    return df if len(df.columns) == 2 else wide_to_vectors(df, key)


def load_with_metadata(spark: SparkSession, path: str, metadata: DataFrame, key: str = "responseId", kind: str = "pkl") -> DataFrame:
    """Embeddings beside the columns of ``metadata`` for the same key; keys without metadata keep nulls."""
    types = metadata.schema[key].dataType.simpleString()
    found = load_embeddings(spark, path, key, kind, "string" if types == "string" else "bigint")
    return found.join(metadata, key, "left")


def embedding(df: DataFrame, name, key: str = "responseId", vector: str = "embedding") -> np.ndarray | None:
    """The vector of one id."""
    row = df.where(F.col(key) == name).select(vector).first()
    return None if row is None else np.array(row[0], np.float32)


def embeddings_of(df: DataFrame, names: list, key: str = "responseId") -> DataFrame:
    """The rows of a list of ids."""
    wanted = df.sparkSession.createDataFrame([Row(**{key: n}) for n in names], df.select(key).schema)
    return df.join(wanted.distinct(), key, "left_semi")


# reports


def write_metadata(df: DataFrame, path: str) -> None:
    """A small table as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def as_json(*columns: str):
    """The columns as one JSON text."""
    return F.to_json(F.struct(*columns))


def write_grouped_report(df: DataFrame, path: str, group: str, template: str, *columns: str) -> None:
    """A text file tree by group, a line per row."""
    df.select(group, F.format_string(template, *columns).alias("value")).write.mode("overwrite").partitionBy(group).text(path)


def pretty(record: dict, width: int = 80) -> str:
    """A record's fields, one a line, long ones cut."""
    show = lambda v: (t if len(t) <= width else t[:width] + "...") if isinstance(v, str) and (t := v) is not None else json.dumps(v, ensure_ascii=False, default=str)
    return "\n".join(f"{k}: {show(v)}" for k, v in record.items())
