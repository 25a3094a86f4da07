"""Embedding analytics: means, similarities, projections, cluster quality, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilate.operators.stats import correlation, resampled
from quilate.operators.tiles import group_gaps, tiles
from quilate.sources.scratch import removed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def doubles(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, F.col(vector).cast("array<double>"))


def mean_vectors(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean per group, through partial means per position."""
    parts = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("_mean"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_mean"))), lambda e: e["_mean"]).alias(vector))


def pairs(df: DataFrame, key: str, vector: str, *carry: str) -> DataFrame:
    """All unordered pairs of a small table of group vectors, with their cosine.

    The comparison of all pairs is the operator's meaning; it is meant for tables
    of group means, whose number the design of an experiment bounds.
    """
    a = df.select(F.col(key).alias("i"), F.col(vector).alias("vi"), *[F.col(c).alias(f"{c}_i") for c in carry])
    b = df.select(F.col(key).alias("j"), F.col(vector).alias("vj"), *[F.col(c).alias(f"{c}_j") for c in carry])
    return a.join(b, F.col("i") < F.col("j")).withColumn("sim", cosine(F.col("vi"), F.col("vj"))).drop("vi", "vj")


def projected(v: Column, axis: Column) -> Column:
    """Projection of v onto the axis; the zero vector for a zero axis."""
    size = dot(axis, axis)
    share = F.when(size > 0, dot(v, axis) / size).otherwise(F.lit(0.0))
    return F.transform(axis, lambda x: x * share)


def cluster_quality(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Within, between and total sums of squares, Calinski-Harabasz index, size variation and explained share."""
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    centres = mean_vectors(df, [by], vector).withColumnRenamed(vector, "c")
    whole = F.array(*[F.lit(x) for x in (mean_vectors(df.withColumn("_all", F.lit(1)), ["_all"], vector).first() or {vector: []})[vector]])
    own = df.join(centres, by).groupBy(by).agg(F.count("*").alias("n"), F.sum(square(F.col(vector), F.col("c"))).alias("w"), F.avg(F.sqrt(square(F.col(vector), F.col("c")))).alias("d"), F.first("c").alias("c"))
    total = own.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("w").alias("wcss"), F.sum(F.col("n") * square(F.col("c"), whole)).alias("bcss"), F.avg("d").alias("mean_intra"), (F.stddev_pop("n") / F.avg("n")).alias("size_cv"))
    index = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("wcss") > 0), (F.col("bcss") / (F.col("k") - 1)) / (F.col("wcss") / (F.col("n") - F.col("k")))).otherwise(0.0)
    tss = F.col("wcss") + F.col("bcss")
    return total.select("n", "k", "wcss", "bcss", tss.alias("tss"), "mean_intra", F.when(F.col("k") > 1, F.col("size_cv")).otherwise(0.0).alias("size_cv"), index.alias("calinski_harabasz"), F.when(tss > 0, F.col("bcss") / tss).otherwise(0.0).alias("explained"))


def centroid_gap(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean distance between the centroids of different clusters (a few), 0 for a single one."""
    c = mean_vectors(df, [by], vector)
    a, b = c.select(F.col(by).alias("g1"), F.col(vector).alias("c1")), c.select(F.col(by).alias("g2"), F.col(vector).alias("c2"))
    gap = F.sqrt(F.aggregate(F.zip_with("c1", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return a.join(b, F.col("g1") < F.col("g2")).agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_inter"))


def resampled_quality(df: DataFrame, key: str, by: str, vector: str = "embedding", resamples: int = 50) -> DataFrame:
    """2.5 and 97.5 percentiles of the cluster metrics over resamples with replacement, from sufficient statistics.

    A cluster's sum of vectors, sum of squares and size are weighed by how often each
    row is drawn, so that one aggregate by resample and cluster serves all metrics.
    Every resample has as many rows as the table.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(vector).isNotNull())
    drawn = resampled(rows, key, carry=(by, vector), resamples=resamples).withColumnRenamed("times", "k")
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    sizes = drawn.groupBy("b", by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * square).alias("sq"))
    parts = drawn.select("b", by, "k", F.posexplode(vector).alias("pos", "x")).groupBy("b", by, "pos").agg(F.sum(F.col("k") * F.col("x")).alias("s"))
    own = parts.groupBy("b", by).agg(F.sum(F.col("s") * F.col("s")).alias("ss")).join(sizes, ["b", by])
    whole = parts.groupBy("b", "pos").agg(F.sum("s").alias("s")).groupBy("b").agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    each = own.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("sq") - F.col("ss") / F.col("n")).alias("wcss"), F.sum(F.col("ss") / F.col("n")).alias("between"), (F.stddev_pop("n") / F.avg("n")).alias("size_cv")).join(whole, "b")
    each = each.withColumn("bcss", F.col("between") - F.col("all") / F.col("n"))
    index = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("wcss") > 0), (F.col("bcss") / (F.col("k") - 1)) / (F.col("wcss") / (F.col("n") - F.col("k")))).otherwise(0.0)
    each = each.withColumns({"calinski_harabasz": index, "explained": F.when(F.col("wcss") + F.col("bcss") > 0, F.col("bcss") / (F.col("wcss") + F.col("bcss"))).otherwise(0.0)})
    metrics = ("wcss", "bcss", "size_cv", "calinski_harabasz", "explained")
    long = each.unpivot("b", list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("valid"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high")).where("valid > 5")


def silhouette(df: DataFrame, key: str, by: str, vector: str = "embedding", block: int = 1024) -> DataFrame:
    """Mean Euclidean silhouette over all points, each against all points.

    Tiles of about ``block`` points meet in cells, so a tile is sent once to a cell and
    not once to every other tile; distances are summed by group inside a task's matrix
    product. The work grows with the square of the points, as the measure does.
    """
    points = df.select(key, F.col(by).alias("g"), vector).where("g IS NOT NULL")
    means = group_gaps(tiles(points, key, vector, ("g",), block), "g")
    same = F.col("gi") == F.col("gj")
    each = means.groupBy("key").agg(F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(score).alias("silhouette"))


def pair_analysis(df: DataFrame, key: str, traits: list[str], columns: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """For every trait and value: pairs of group vectors, centred on the mean of that value's group.

    ``df`` has a row per group with its traits. Two analyses: "centering" takes all
    groups and centres them on the value's mean, "filtered" only the value's groups. A
    row per pair: its cosine before and after, and the percentage of traits in which
    both agree. One job for the whole grid; all pairs of the groups are the operator's
    meaning (the design bounds their number).
    """
    columns = columns or traits
    cells = df.select(key, vector, *traits, F.explode(F.array(*[F.struct(F.lit(c).alias("trait"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    centre = mean_vectors(cells.select(F.col("x.trait").alias("trait"), F.col("x.value").alias("value"), vector), ["trait", "value"], vector).withColumnRenamed(vector, "centre")
    side = lambda n: df.select(F.col(key).alias(n), F.col(vector).alias(f"v{n}"), F.struct(*[F.col(t).cast("string").alias(t) for t in traits]).alias(f"t{n}"))
    match = sum((F.col("ti")[t].eqNullSafe(F.col("tj")[t]).cast("int") for t in traits), F.lit(0)) * (100.0 / len(traits))
    two = side("i").join(side("j"), F.col("i") < F.col("j")).withColumns({"original": cosine(F.col("vi"), F.col("vj")), "match_pct": match})
    held = F.lit(False)
    for c in columns:
        held |= (F.col("trait") == c) & F.col("ti")[c].eqNullSafe(F.col("value")) & F.col("tj")[c].eqNullSafe(F.col("value"))
    every = two.join(F.broadcast(centre), F.lit(True)).withColumns({"centred": cosine(minus(F.col("vi"), F.col("centre")), minus(F.col("vj"), F.col("centre"))), "held": held})
    rows = every.select("trait", "value", "i", "j", "original", "centred", "match_pct", F.explode(F.when(F.col("held"), F.array(F.lit("centering"), F.lit("filtered"))).otherwise(F.array(F.lit("centering")))).alias("analysis"))
    return rows


def pair_statistics(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Per analysis (trait, value, analysis of ``groups``): numbers, means, deviations and correlations; fewer than two groups give ``insufficient_data``.

    ``groups`` has (trait, value, analysis, group_size).
    """
    names = ["trait", "value", "analysis"]
    r = lambda c, n, name: F.round(c, n).alias(name)
    guarded = correlation
    made = pairs.groupBy(*names).agg(
        F.count("*").alias("total_pairs"), r(F.avg("original"), 6, "original_mean"), r(F.stddev_pop("original"), 6, "original_std"),
        r(F.avg("centred"), 6, "centred_mean"), r(F.stddev_pop("centred"), 6, "centred_std"), r(F.min("centred"), 6, "centred_min"), r(F.max("centred"), 6, "centred_max"),
        r(F.avg("match_pct"), 2, "match_mean"), r(F.stddev_pop("match_pct"), 2, "match_std"), r(F.min("match_pct"), 2, "match_min"), r(F.max("match_pct"), 2, "match_max"),
        r(guarded("centred", "original"), 6, "centred_vs_original"), r(guarded("centred", "match_pct"), 6, "centred_vs_match"),
    )
    status = F.when(F.col("group_size") < 2, "insufficient_data").otherwise("ok").alias("status")
    return groups.join(made, names, "left").select(*names, "group_size", status, *[c for c in made.columns if c not in names])


def components(edges: DataFrame, nodes: DataFrame, key: str, folder: str) -> DataFrame:
    """Component (smallest member) of each node; isolated nodes are their own.

    In each round every node takes the smallest label among its neighbours and then
    the label of that label, so that paths halve and the rounds grow with the
    logarithm of the longest. Rounds are written under ``folder``, a place that all
    executors share, and removed when the next one is there.
    """
    spark = nodes.sparkSession
    both = edges.select("i", "j").unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct()
    both.write.mode("overwrite").parquet(f"{folder}/edges")
    both = spark.read.parquet(f"{folder}/edges")
    labels, turn = nodes.select(F.col(key).alias("node"), F.col(key).alias("component")).distinct(), 0
    while True:
        near = both.join(labels.select(F.col("node").alias("j"), "component"), "j").groupBy(F.col("i").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("next"), F.col("component").alias("old"))
        # whoever is named as a label tells its own smallest, also to the node that named it
        told = hooked.groupBy(F.col("old").alias("root")).agg(F.min("next").alias("told"))
        jump = hooked.join(told, F.col("next") == F.col("root"), "left").select("node", F.least("next", F.coalesce("told", "next")).alias("component"), "old")
        jump.write.mode("overwrite").parquet(f"{folder}/labels-{turn}")
        labels = spark.read.parquet(f"{folder}/labels-{turn}")
        if turn:
            removed(spark, f"{folder}/labels-{turn - 1}")
        if labels.where("component < old").isEmpty():
            return labels.select("node", "component")
        labels, turn = labels.select("node", "component"), turn + 1
