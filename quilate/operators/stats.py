"""Descriptive statistics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilate.sources.scratch import written


def ranked(df: DataFrame, value: str, *by: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Non-null values with their place ``k`` (from 1) in their group, in order of the value, then of ``then``.

    Rows are dealt by ranges of group and value and sorted there; a table of counts
    per partition and group, small and of known size, gives each partition its first
    place. No group is sorted in one task.
    """
    order = [*by, value, *then]
    dealt = df.where(F.col(value).isNotNull()).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.select(*order, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    firsts = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*[F.col(b) for b in by] or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = firsts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return placed.join(starts, same).select(*order, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("k"))


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """Exact quantiles with linear interpolation, columns q0, q1 and so on, of each group."""
    places = ranked(df, value, *by)
    sizes = places.groupBy(*by).agg(F.max("k").alias("_n"))
    at = [(F.col("_n") - 1) * F.lit(float(q)) for q in shares]
    wanted = sizes.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], "_n", F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x) + 1, F.ceil(x) + 1) for x in at])))).alias("_k"))
    same = F.col("k") == F.col("_k")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_g{i}"))
    # a few places of each group
    found = places.join(wanted, same).groupBy(*by).agg(F.max("_n").alias("_n"), F.map_from_entries(F.collect_set(F.struct("k", F.col(value).cast("double").alias("v")))).alias("_v"))
    out = []
    for i, x in enumerate(at):
        low, high = F.element_at("_v", F.floor(x) + 1), F.element_at("_v", F.ceil(x) + 1)
        out.append((low + (high - low) * (x - F.floor(x))).alias(f"q{i}"))
    return found.select(*by, *out)


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of each group."""
    plain = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, value, (0.25, 0.5, 0.75), *by).withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    if not by:
        return plain.join(q, F.lit(True), "left").select("count", "mean", "std", "min", "p25", "p50", "p75", "max")
    q = q.withColumnsRenamed({b: f"_q_{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_q_{b}"))
    return plain.join(q, same, "left").select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def fences(df: DataFrame, value: str) -> tuple[float, float]:
    """Lower and upper 1.5 x IQR fence."""
    found = quantiles(df, value, (0.25, 0.75)).first()
    q1, q3 = (found.q0, found.q1) if found and found.q0 is not None else (math.nan, math.nan)
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def without_outliers(df: DataFrame, value: str) -> DataFrame:
    low, high = fences(df, value)
    return df.where(F.col(value).between(low, high))


def ecdf(df: DataFrame, value: str, key: str, *by: str) -> DataFrame:
    """Share of a group's values up to each; ties have places of their own, in order of the key. Nulls come last."""
    places = ranked(df, value, *by, then=(key,))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).withColumnsRenamed({b: f"_g_{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return places.join(F.broadcast(sizes) if not by else sizes, same).select(*by, key, value, (F.col("k") / F.col("_n")).alias("y"))


def zscores(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``df`` with ``z``: distance from the group's mean in sample deviations."""
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")).withColumnsRenamed({b: f"_g_{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return df.join(m, same).withColumn("z", (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s", *[f"_g_{b}" for b in by])


def hashed_order(*columns: str, seed: int = 42) -> list[Column]:
    """A reproducible random order: a 64-bit digest of the seed and the columns, then the columns."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
    return [digest, *map(F.col, columns)]


def sampled(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """``n`` rows by a fixed seed; the same rows whatever the partitioning."""
    return df.orderBy(*hashed_order(*key, seed=seed)).limit(n)


def sampled_per_group(df: DataFrame, n: int, by: str, *key: str, seed: int = 42) -> DataFrame:
    """``n`` rows of each group by a fixed seed, with their place ``r``; a group limit comes before the shuffle."""
    order = Window.partitionBy(by).orderBy(*hashed_order(*key, seed=seed))
    return df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)


def resampled(df: DataFrame, key: str, *by: str, carry: tuple[str, ...] = (), resamples: int = 50) -> DataFrame:
    """Resamples with replacement, each of exactly as many rows as the table (or as its group): the rows drawn, ``b`` and ``times``.

    Rows are numbered in order of the key. Each of them makes one draw for every resample:
    a digest of its number and the resample's picks the number of a row. Draws are counted
    before they are shuffled, and meet the rows in a join on the number.
    """
    placed = written(ranked(df, key, *by, then=carry), "numbered")
    names = [f"_g{i}" for i in range(len(by))]
    sizes = placed.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.max("k").alias("_n"))
    own = F.lit(True)
    for c, n in zip(by, names, strict=True):
        own &= F.col(c).eqNullSafe(F.col(n))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("k").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("bigint")
    drawing = placed.select(*by, "k").join(sizes, own).select(*names, "k", "_n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    drawn = drawing.groupBy(*names, "b", (F.pmod(digest, F.col("_n")) + 1).alias("_pick")).agg(F.count("*").alias("times"))
    return placed.join(drawn, own & (F.col("k") == F.col("_pick"))).select(*by, key, *carry, "b", "times")


def _picks(first: int, count: int, size: int, resamples: int) -> np.ndarray:
    """Rows (from 0) that the rows from ``first`` draw, a line for each resample; as in ``resampled``."""
    ends = [b"|%d" % b for b in range(1, resamples + 1)]
    digests = b"".join([hashlib.md5(k + e, usedforsecurity=False).digest()[:4] for k in (b"%d" % k for k in range(first, first + count)) for e in ends])
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(count, resamples).T % size


def resampled_means(df: DataFrame, key: str, value: str, *by: str, resamples: int = 50, block: int = 1 << 16) -> DataFrame:
    """The mean ``_m`` of each group's non-null values in each resample ``b`` of ``resampled``.

    Draws aren't rows: a run of rows makes its draws at once and sends each block of picked
    rows two bytes a draw. A block of values sums up what was drawn from it.
    """
    spark, names = df.sparkSession, [f"_g{i}" for i in range(len(by))]
    placed = written(ranked(df.where(F.col(value).isNotNull()), key, *by, then=(value,)), "numbered")
    groups = placed.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.max("k").alias("_n"))
    groups = written(groups.withColumn("_g", F.monotonically_increasing_id()), "groups")
    own = F.lit(True)
    for c, n in zip(by, names, strict=True):
        own &= F.col(c).eqNullSafe(F.col(n))
    values = placed.join(groups, own).select("_g", F.floor((F.col("k") - 1) / block).cast("int").alias("_block"), F.pmod(F.col("k") - 1, F.lit(block)).cast("int").alias("at"), F.col(value).cast("double").alias("v"))
    run = max(1, block // 2)
    runs = groups.where("_n > 0").select("_g", "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n", F.lit(run).cast("bigint"))).alias("first"))
    runs = runs.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, n, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                at, offset = np.divmod(_picks(first, min(run, n - first + 1), n, resamples), block)
                blocks = -(-n // block)
                counts = np.bincount((at * resamples + np.arange(resamples)[:, None]).ravel(), minlength=blocks * resamples).reshape(blocks, resamples)
                offset = offset.ravel()[np.argsort(at.ravel(), kind="stable")].astype("<u4" if block > 1 << 16 else "<u2")
                cuts = np.concatenate([[0], np.cumsum(counts.sum(1))])
                some = np.flatnonzero(np.diff(cuts))
                columns = [pa.array(np.full(len(some), g)), pa.array(some, pa.int32()), pa.array([counts[i].astype("<u4").tobytes() for i in some], pa.binary()), pa.array([offset[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_g", "_block", "counts", "offsets"])

    draws = runs.mapInArrow(drawn, "_g bigint, _block int, counts binary, offsets binary")

    def summed(own: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        x, s, n = np.zeros(block), np.zeros(resamples), np.zeros(resamples, np.int64)
        x[own["at"].to_numpy()] = own["v"].to_numpy()
        for c, o in zip(draws["counts"], draws["offsets"], strict=True):
            times = np.frombuffer(c, "<u4")
            s += np.bincount(np.repeat(np.arange(resamples), times), x[np.frombuffer(o, "<u4" if block > 1 << 16 else "<u2")], resamples)
            n += times
        return pd.DataFrame({"_g": draws["_g"].iloc[:1].repeat(resamples).to_numpy(), "b": np.arange(1, resamples + 1), "s": s, "n": n}) if len(draws) else pd.DataFrame({"_g": [], "b": [], "s": [], "n": []})

    sums = values.groupBy("_g", "_block").cogroup(draws.groupBy("_g", "_block")).applyInPandas(summed, "_g bigint, b int, s double, n bigint")
    means = sums.groupBy("_g", "b").agg((F.sum("s") / F.sum("n")).alias("_m"))
    return means.join(groups, "_g").select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "b", "_m")


def bootstrap_interval(df: DataFrame, key: str, value: str, *by: str, resamples: int = 50) -> DataFrame:
    """2.5 and 97.5 percentiles of each group's mean over resamples; a group of five or fewer valid resamples has none."""
    means = resampled_means(df, key, value, *by, resamples=resamples).where("_m IS NOT NULL")
    # a group has as many means as there are resamples
    return means.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high")).where("_n > 5").drop("_n")


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where either side doesn't vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = (high - low) / bins if low is not None and high > low else 1.0
    at = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def studentised_range_cdf(q: float, k: int, df: float, steps: int = 96) -> float:
    """P(range of k standard normals / independent chi estimate <= q), by nested numeric integration."""
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))

    def inner(w: float) -> float:
        total, h = 0.0, 16 / steps
        for i in range(steps + 1):
            z = -8 + i * h
            total += (0.5 if i in (0, steps) else 1) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * max(phi(z) - phi(z - w), 0) ** (k - 1)
        return k * total * h

    if df > 5000:
        return inner(q)
    log_c = df / 2 * math.log(df / 2) - math.lgamma(df / 2) + math.log(2)
    spread = 6 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - spread * 1.4), 1 + spread * 1.6
    h, total = (high - low) / steps, 0.0
    for i in range(steps + 1):
        s = low + i * h
        total += (0.5 if i in (0, steps) else 1) * math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * inner(q * s)
    return min(1.0, total * h)


def studentised_range_quantile(p: float, k: int, df: float) -> float:
    low, high = 0.0, 50.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if studentised_range_cdf(middle, k, df) < p else (low, middle)
    return (low + high) / 2


def tukey(df: DataFrame, group: str, value: str, confidence: float = 0.99) -> DataFrame:
    """Tukey-Kramer comparisons of all pairs of groups.

    Spark reduces the rows to a count, mean and sum of squares per group; the pairs of groups stay in Spark.
    """
    stats = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    k, n, ss = stats.agg(F.count("*"), F.sum("n"), F.sum("ss")).first()
    if not k or k < 2 or n <= k:
        critical, within = math.nan, math.nan
    else:
        critical, within = studentised_range_quantile(confidence, k, n - k), ss / (n - k)
    a = stats.select(F.col("g").alias("group1"), F.col("n").alias("n1"), F.col("m").alias("m1"))
    b = stats.select(F.col("g").alias("group2"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    reach = F.lit(critical) * F.sqrt(F.lit(within) / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    gap = F.col("m2") - F.col("m1")
    return a.join(b, F.col("group1") < F.col("group2")).select("group1", "group2", gap.alias("meandiff"), (gap - reach).alias("lower"), (gap + reach).alias("upper"), (F.abs(gap) > reach).alias("reject"))
