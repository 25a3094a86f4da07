"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the session is local (tests) a fresh
    temporary folder takes its place; a cluster without the setting is an error,
    because its executors would each write to their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not context.isDefined() and spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context.get() if context.isDefined() else "file://" + tempfile.mkdtemp(prefix="quilate-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, **options: object) -> DataFrame:
    """Write ``df`` (with the writer's ``options``) to the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors. They are removed when the driver's
    process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quilate-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)
    swept(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._quilate_path = path
    return out


def bucketed(df: DataFrame, key: str, *then: str) -> DataFrame:
    """As ``written``, in buckets of ``key`` that are sorted by it (and ``then``): joins and aggregates on it need no shuffle.

    There are as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    name = f"quilate_{uuid.uuid4().hex}"
    path, n = f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key, *then).saveAsTable(name)
    atexit.register(_remove, spark, path)
    swept(spark)
    out = spark.table(name)
    out._quilate_path, out._quilate_table = path, name
    return out


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` stands for a dot) that hold inside the block only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def tidied(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators of several jobs: each job's shuffle files go when it ends, not when the driver collects garbage.

    The setting holds only while ``work`` runs; what it returns is executed by the caller.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @wraps(work)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(name, "false")
        conf.set(name, "true")
        try:
            return work(df, *args, **kwargs)
        finally:
            conf.set(name, before)

    return run


def swept(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that nothing refers to; it learns that only when the JVM collects garbage."""
    spark.sparkContext._jvm.System.gc()


def discarded(df: DataFrame) -> None:
    """Delete the files of a frame from ``written`` that nothing will read any more."""
    path, name = getattr(df, "_quilate_path", None), getattr(df, "_quilate_table", None)
    if name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Places:
    """(document, number) as one integer that keeps their order: a bigint where the ids' range allows, else a decimal.

    It can be aggregated in place, which a struct can't.
    """

    BITS = 30

    def __init__(self, docs: DataFrame, key: str):
        low, high = docs.agg(F.min(key), F.max(key)).first()
        self.low, self.type = low or 0, docs.schema[key].dataType.simpleString()
        self.one = "bigint" if low is None or high - low + 1 < 2 ** (63 - self.BITS) else "decimal(38,0)"

    def of(self, document: str, number: str) -> Column:
        return ((F.col(document).cast(self.one) - F.lit(self.low).cast(self.one)) * F.lit(2**self.BITS).cast(self.one) + F.col(number)).cast(self.one)

    def document(self, place: str) -> Column:
        if self.one == "bigint":
            return (F.shiftright(place, self.BITS) + F.lit(self.low)).cast(self.type)
        return (F.floor(F.col(place) / F.lit(2**self.BITS).cast("decimal(20,0)")).cast("decimal(38,0)") + F.lit(self.low)).cast(self.type)

    def number(self, place: str) -> Column:
        if self.one == "bigint":
            return F.col(place).bitwiseAND(F.lit(2**self.BITS - 1)).cast("int")
        return (F.col(place) % F.lit(2**self.BITS).cast("decimal(20,0)")).cast("int")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
