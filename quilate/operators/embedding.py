"""Low-dimensional embedding of vectors by their exact neighbour graph.

1. Each vector's nearest others, by cosine (unit vectors) or Euclidean distance.
2. Fuzzy weights: the nearest other has weight 1, farther ones fall off exponentially, at
   a scale that makes the weights of a vector add up to log2 of their number. The weights
   of both directions are joined by the probabilistic sum a + b - ab.
3. Spectral start: the leading eigenvectors of the normalised graph but the trivial one,
   by orthogonal iteration; the graph is applied by a join and an aggregate, and only the
   Gram matrix of the few columns comes to the driver.
4. Layout: in each epoch every vector is drawn along its edges and pushed from a few others
   that a hash of its number and the epoch picks; all move at once, by steps that shrink.

A fixed seed gives the same embedding up to the rounding of sums. Null keys and unusable
vectors take no part; fewer than two vectors have no graph and get zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from quilate.operators.tiles import Tiles, neighbours, tiles
from quilate.sources.scratch import written

#: The curve of the low-dimensional similarity 1 / (1 + a d^(2 b)) for a least distance of 0.1.
CURVE = (1.577, 0.8951)


def fuzzy_weights(near: DataFrame) -> DataFrame:
    """Directed weights (i, j, w) of (key, other, distance, rank)."""
    lists = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("x")).select("key", col("x.other").alias("others"), col("x.distance").alias("distances"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, others, weights = [], [], []
            for row in batch.to_pylist():
                d = np.array(row["distances"])
                away = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0.0), 0)
                want, low, high, scale = np.log2(max(2, len(d))), 0.0, np.inf, 1.0
                for _ in range(64):
                    total = np.exp(-away / scale).sum()
                    if abs(total - want) < 1e-5:
                        break
                    low, high = (low, scale) if total > want else (scale, high)
                    scale = (low + high) / 2 if np.isfinite(high) else scale * 2
                keys += [row["key"]] * len(d)
                others += row["others"]
                weights.append(np.exp(-away / max(scale, 1e-3 * d.mean() if d.mean() > 0 else 1e-12)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array(np.concatenate(weights) if weights else [], pa.float64())], ["i", "j", "w"])

    return lists.mapInArrow(scaled, "i bigint, j bigint, w double")


def fuzzy_graph(t: Tiles, k: int = 15) -> DataFrame:
    """Symmetric weights (i, j, w), a row for each direction."""
    one = written(fuzzy_weights(neighbours(t, k)), "fuzzy")
    both = one.select("i", "j", "w", F.lit(0.0).alias("back")).unionAll(one.select(col("j").alias("i"), col("i").alias("j"), F.lit(0.0).alias("w"), col("w").alias("back")))
    joined = both.groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("back").alias("back"))
    return written(joined.select("i", "j", (col("w") + col("back") - col("w") * col("back")).alias("w")), "graph")


def _seeded(key: Column, seed: int, k: int) -> Column:
    """A number in [-0.5, 0.5) for a key and a column."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), key), F.lit(1 << 20)) / float(1 << 20) - 0.5


def _summed(rows: DataFrame, by: str, vector: str, n: int) -> DataFrame:
    return rows.groupBy(by).agg(F.array(*[F.sum(col(vector)[k]) for k in range(n)]).alias(vector))


def _gram(rows: DataFrame, vector: str, n: int) -> np.ndarray:
    """Inner products of the columns of a table of vectors: a few numbers."""
    found = rows.agg(*[F.sum(col(vector)[a] * col(vector)[b]) for a in range(n) for b in range(a, n)]).first()
    out, values = np.zeros((n, n)), iter(found)
    for a in range(n):
        for b in range(a, n):
            out[a, b] = out[b, a] = next(values) or 0.0
    return out


def _turned(vector: str, matrix: np.ndarray) -> Column:
    """The vector times a small matrix."""
    n = len(matrix)
    return F.array(*[sum((col(vector)[a] * float(matrix[a, k]) for a in range(n)), F.lit(0.0)) for k in range(matrix.shape[1])])


def spectral(graph: DataFrame, nodes: DataFrame, n: int, seed: int = 42, rounds: int = 8) -> DataFrame:
    """(key, x): the ``n`` leading eigenvectors after the trivial one, scaled to a largest coordinate of about 10."""
    m = n + 1
    degree = graph.groupBy("i").agg(F.sum("w").alias("d"))
    scaled = graph.join(degree, "i").join(degree.select(col("i").alias("j"), col("d").alias("e")), "j")
    # half of the graph and half of each vector itself, so that no eigenvalue is negative
    scaled = written(scaled.select("i", "j", (0.5 * col("w") / F.sqrt(col("d") * col("e"))).alias("w")), "scaled")
    base = nodes.join(degree, col("key") == col("i"), "left").select("key", F.coalesce(F.sqrt("d"), F.lit(0.0)).alias("root"))
    x = written(base.select("key", F.array("root", *[_seeded(col("key"), seed, k) for k in range(n)]).alias("x")), "spectral")
    for _ in range(rounds):
        spread = scaled.join(x.select(col("key").alias("j"), "x"), "j").select(col("i").alias("key"), F.transform("x", lambda v: v * col("w")).alias("x"))
        kept = x.select("key", F.transform("x", lambda v: 0.5 * v).alias("x"))
        y = written(_summed(spread.unionAll(kept), "key", "x", m), "spectral")
        # orthogonal columns again: the inverse of the Gram matrix's root
        gram = _gram(y, "x", m) + 1e-12 * np.eye(m)
        x = y.select("key", _turned("x", np.linalg.inv(np.linalg.cholesky(gram)).T).alias("x"))
    x = written(x, "spectral")
    reach = x.agg(*[F.max(F.abs(col("x")[k])) for k in range(1, m)]).first()
    return x.select("key", F.array(*[col("x")[k] * (10.0 / max(reach[k - 1] or 0.0, 1e-12)) for k in range(1, m)]).alias("x"))


def layout(graph: DataFrame, start: DataFrame, count: int, n: int, epochs: int, seed: int = 42, others: int = 5) -> DataFrame:
    """Move the points of ``start`` (key, x) along the graph's edges and away from others."""
    a, b = CURVE
    numbered = written(start.select("key", "x", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(max(1, count))).alias("slot")), "layout")
    minus = lambda p, q: F.zip_with(p, q, lambda u, v: u - v)
    square = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    held = lambda v: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), v))
    for epoch in range(epochs):
        step = 1.0 - epoch / epochs
        other = numbered.select(col("key").alias("j"), col("x").alias("y"), "slot")
        drawn = graph.join(numbered.select(col("key").alias("i"), "x"), "i").join(other.drop("slot"), "j").withColumn("d", square("x", "y"))
        pull = -2 * a * b * F.pow("d", b - 1) / (1 + a * F.pow("d", b)) * col("w")
        drawn = drawn.select(col("i").alias("key"), F.transform(minus("x", "y"), lambda v: held(v * F.when(col("d") > 0, pull).otherwise(0.0))).alias("f"))
        picks = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(epoch * others + r)), F.lit(max(1, count))) for r in range(others)]))
        pushed = numbered.select("key", "x", picks.alias("slot")).join(other, "slot").where("key <> j").withColumn("d", square("x", "y"))
        push = 2 * b / ((0.001 + col("d")) * (1 + a * F.pow("d", b)))
        pushed = pushed.select("key", F.transform(minus("x", "y"), lambda v: held(v * push)).alias("f"))
        force = _summed(drawn.unionAll(pushed), "key", "f", n).withColumnRenamed("key", "k")
        moved = numbered.join(force, col("key") == col("k"), "left")
        added = F.zip_with("x", F.coalesce("f", F.array(*[F.lit(0.0)] * n)), lambda u, f: u + step * 0.1 * f)
        numbered = written(moved.select("key", added.alias("x"), "slot"), "layout")
    return numbered.select("key", "x")


def neighbour_embedding(df: DataFrame, key: str, vector: str = "embedding", dimensions: int = 10, k: int = 15, cosine: bool = True, epochs: int = 6, seed: int = 42, size: int = 1024) -> DataFrame:
    """Each usable key with its embedding, an array of ``dimensions`` numbers."""
    t = tiles(df, key, vector, size=size, unit=cosine)
    graph = fuzzy_graph(t, k)
    nodes = t.frame.select(F.explode("keys").alias("key"))
    start = spectral(graph, nodes, dimensions, seed)
    return layout(graph, start, t.rows, dimensions, epochs, seed).select(col("key").alias(key), col("x").alias(vector))
