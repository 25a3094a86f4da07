"""Readers and writers: tables, text templates, trait lists, embeddings, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts that ``spread`` makes at most.
MOST_PARTS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, part: int = 16 << 20) -> DataFrame:
    """Rows dealt over all cores, in parts of about ``part`` bytes of the input's files, for costly work on texts.

    A row group is read by one task, whatever its size and the cores; the work on its texts isn't left to that task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(min(max(cores, -(-size // part)), MOST_PARTS))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; cells may hold line feeds."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several Parquet paths that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists as rows (trait, value)."""
    one = spark.read.json(path, multiLine=True)
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("trait", "values")).select("trait", F.explode("values").alias("value"))


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Template files of a folder with their names."""
    found = spark.read.text(f"{folder}/*.tmplt", wholetext=True)
    return found.select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.tmplt$", 1).alias("template_name"), F.trim("value").alias("original_prompt"))


def wide_to_vectors(df: DataFrame, key: str = "responseId") -> DataFrame:
    """A column per dimension becomes one array column."""
    return df.select(key, F.array(*[F.col(f"`{c}`").cast("float") for c in df.columns if c != key]).alias("embedding"))


def write_nested_json(df: DataFrame, path: str, *levels: str) -> None:
    df.write.mode("overwrite").partitionBy(*levels).json(path)


def write_report(df: DataFrame, path: str, template: str, *columns: str) -> None:
    df.select(F.format_string(template, *columns).alias("value")).write.mode("overwrite").text(path)
