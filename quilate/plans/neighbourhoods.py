"""Queries on all vectors: near neighbours, similarity graphs, hierarchical density clusters and their report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilate.operators import clusters, density, embedding, tiles, vectors
from quilate.plans.catalogue import query, r6
from quilate.sources import stores
from quilate.sources.scratch import new_folder, written
from quilate.sources.tables import table

#: Lengths of vectors and the cosine of all pairs of different ones.
_COSINES = "n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS sim FROM n a JOIN n b ON a.vec_id <> b.vec_id)"


def _embeddings(s, d):
    return table(s, d, "embeddings")


@query(f"WITH {_COSINES} SELECT n.vec_id, t.threshold, count(i)::BIGINT AS n FROM n CROSS JOIN (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold) t LEFT JOIN pairs ON i = n.vec_id AND sim >= t.threshold GROUP BY ALL")
def similarity_degrees(s, d):
    """The degree of every vector in the similarity graph of each threshold."""
    found = tiles.degrees(tiles.tiles(_embeddings(s, d), "vec_id", unit=True), [0.1, 0.3, 0.5, 0.7, 0.9])
    return found.select(F.col("key").alias("vec_id"), "threshold", "n")


@query("WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), r AS (SELECT a.vec_id, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v)) AS rank FROM n a JOIN n b ON a.vec_id <> b.vec_id) SELECT vec_id, rank::INTEGER AS rank, round(distance, 5) AS distance FROM r WHERE rank <= 5")
def nearest_neighbours(s, d):
    """Distances of the five nearest others of every vector."""
    found = tiles.neighbours(tiles.tiles(_embeddings(s, d), "vec_id"), 5)
    return found.select(F.col("key").alias("vec_id"), "rank", F.round("distance", 5).alias("distance"))


@query()
def hierarchical_clusters(s, d):
    """Every vector with its density cluster, -1 for noise."""
    return density.hierarchical_clusters(_embeddings(s, d), "vec_id")


@query()
def cluster_report(s, d):
    """Size, share, counts and dominant label of each density cluster, and of noise."""
    found = written(density.hierarchical_clusters(_embeddings(s, d), "vec_id"))
    return clusters.report(found, _embeddings(s, d).select("vec_id", F.col("label").cast("string").alias("label")), "vec_id", ["label"])


@query("SELECT kind, vec_id, len(embedding)::INTEGER AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings, (SELECT unnest(['npy', 'parquet', 'pkl']) AS kind)")
def embedding_store(s, d):
    """All vectors written to files of each format and read back."""
    kinds, path = ("npy", "parquet", "pkl"), new_folder(s, "embeddings")
    stores.save_embeddings(_embeddings(s, d), path, "vec_id", formats=kinds)
    read = [stores.load_embeddings(s, path, "vec_id", k, "bigint").select(F.lit(k).alias("kind"), "vec_id", "embedding") for k in kinds]
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return reduce(DataFrame.unionAll, read).select("kind", "vec_id", F.size("embedding").alias("dimensions"), F.round(total, 5).alias("total"))


def _reduced(s, d):
    """Ten dimensions by the neighbour graph, and density clusters there."""
    low = written(embedding.neighbour_embedding(_embeddings(s, d), "vec_id", dimensions=10))
    return low, written(density.hierarchical_clusters(low, "vec_id"))


@query()
def neighbour_embedding(s, d):
    """Every vector in ten dimensions."""
    return embedding.neighbour_embedding(_embeddings(s, d), "vec_id", dimensions=10)


@query()
def reduced_silhouette(s, d):
    """The silhouette of the density clusters in ten dimensions, noise left out, and the report's numbers of them."""
    low, found = _reduced(s, d)
    inner = low.join(found.where(F.col("cluster") != density.NOISE), "vec_id")
    numbers = found.agg(F.count("*").alias("vectors"), F.count_if(F.col("cluster") == density.NOISE).alias("noise"), F.count_distinct(F.when(F.col("cluster") != density.NOISE, F.col("cluster"))).alias("clusters"))
    return vectors.silhouette(inner, "vec_id", "cluster").select(F.coalesce("silhouette", F.lit(0.0)).alias("silhouette")).join(numbers, F.lit(True))
