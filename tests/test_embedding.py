"""The neighbour embedding against its definitions and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quilate.operators import embedding, tiles


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.25, (50, 12)) for c in 3 * np.eye(12)[:4]])
    rows = [(int(i), x[i].tolist()) for i in range(len(x))] + [(999, None)]
    return x, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_weights_add_up_and_are_symmetric(spark, blobs):
    x, df = blobs
    t = tiles.tiles(df, "vec_id", unit=True, size=64)
    near = tiles.neighbours(t, 8)
    sums = {r.i: r.s for r in embedding.fuzzy_weights(near).groupBy("i").agg(F.sum("w").alias("s")).collect()}
    assert len(sums) == 200 and np.allclose(list(sums.values()), 3.0, atol=1e-3)
    graph = {(r.i, r.j): r.w for r in embedding.fuzzy_graph(t, 8).collect()}
    assert all(abs(graph[j, i] - w) < 1e-12 and 0 < w <= 1 for (i, j), w in graph.items())
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert all(int(np.argmax(s[i])) in {b for a, b in graph if a == i} for i in range(200))


def test_spectral_start_is_the_leading_space(spark):
    # a ring: the leading eigenvectors are known
    n = 12
    edges = [(i, (i + d) % n, 1.0) for i in range(n) for d in (1, n - 1)]
    graph = spark.createDataFrame(edges, "i bigint, j bigint, w double")
    nodes = spark.range(n).withColumnRenamed("id", "key")
    got = {r.key: r.x for r in embedding.spectral(graph, nodes, 2, rounds=20).collect()}
    p = np.array([got[i] for i in range(n)])
    p = p - p.mean(0)
    w = np.zeros((n, n))
    for i, j, _ in edges:
        w[i, j] = 0.5
    values, vectors = np.linalg.eigh(w)
    lead = vectors[:, np.argsort(-values)[1:3]]
    left = p - lead @ (lead.T @ p)
    assert np.linalg.norm(left) < 0.05 * np.linalg.norm(p)


def test_neighbours_are_preserved(spark, blobs):
    x, df = blobs
    got = {r.vec_id: r.embedding for r in embedding.neighbour_embedding(df, "vec_id", dimensions=3, k=10, epochs=4).collect()}
    assert sorted(got) == list(range(200)) and all(len(v) == 3 and np.isfinite(v).all() for v in got.values())
    y = np.array([got[i] for i in range(200)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]

    def near(m):
        np.fill_diagonal(m, np.inf)
        return np.argsort(m, 1)[:, :10]

    before, after = near(1 - unit @ unit.T), near(((y[:, None] - y[None]) ** 2).sum(2))
    share = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(before, after, strict=True)])
    same = np.mean((after // 50) == (np.arange(200) // 50)[:, None])
    assert same > 0.97 and share > 3 * 10 / 199  # by chance a twentieth would be


def test_few_vectors(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert embedding.neighbour_embedding(spark.createDataFrame([], schema), "vec_id", dimensions=2, epochs=1).count() == 0
    one = embedding.neighbour_embedding(spark.createDataFrame([(3, [1.0, 2.0])], schema), "vec_id", dimensions=2, epochs=1).collect()
    assert len(one) == 1 and np.isfinite(one[0].embedding).all()
