"""What clusters are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col

NOISE = -1


def report(found: DataFrame, attributes: DataFrame, key: str, names: list[str], cluster: str = "cluster") -> DataFrame:
    """A row per cluster and attribute, noise last in its own section.

    section ("clusters" or "noise"), cluster, attribute, size, share (of all members, in
    percent), values (each with count and percentage of the cluster, most frequent
    first), dominant value and purity. Members without a row of attributes count with a
    null value; equal counts are ordered by value.
    """
    members = found.select(key, col(cluster).alias("cluster")).where(col("cluster").isNotNull())
    held = F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), col(n).cast("string").alias("value")) for n in names]))
    counts = members.join(attributes.select(key, *names), key, "left").select("cluster", held.alias("x")).groupBy("cluster", "x.attribute", "x.value").agg(F.count("*").alias("n"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    # a number, joined so that the report stays lazy
    shares = sizes.join(members.agg(F.count("*").alias("every")), F.lit(True)).select(col("cluster").alias("c"), "size", F.round(100.0 * col("size") / col("every"), 2).alias("share"))
    own = counts.join(shares, col("cluster") == col("c")).withColumn("pct", F.round(100.0 * col("n") / col("size"), 2))
    values = F.array_sort(F.collect_list(F.struct((-col("n")).alias("order"), "value", "n", "pct")))
    made = own.groupBy("cluster", "attribute", "size", "share").agg(values.alias("v"))
    section = F.when(col("cluster") == NOISE, "noise").otherwise("clusters").alias("section")
    purity = F.round(col("v")[0]["n"] / col("size"), 4).alias("purity")
    return made.select(section, "cluster", "attribute", "size", "share", F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"), x["pct"].alias("pct"))).alias("values"), col("v")[0]["value"].alias("dominant"), purity)


def average_purity(found: DataFrame, attributes: DataFrame, key: str, attribute: str, cluster: str = "cluster") -> DataFrame:
    """Per attribute value's clustering: the mean purity over clusters and the mean weighed by size; noise left out."""
    rows = report(found.where(col(cluster) != NOISE), attributes, key, [attribute], cluster)
    return rows.agg(F.count("*").alias("clusters"), F.round(F.avg("purity"), 4).alias("mean_purity"), F.round(F.sum(col("purity") * col("size")) / F.sum("size"), 4).alias("weighted_purity"))
