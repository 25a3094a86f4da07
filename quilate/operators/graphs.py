"""Communities of small similarity graphs (the nodes are group means, a few dozen per graph)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _modularity_moves(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Local moving by modularity gain, then merging, until no community changes (a multi-level search)."""
    weight: dict[int, dict[int, float]] = {}
    for i, j, w in edges:
        weight.setdefault(i, {})[j] = weight.setdefault(i, {}).get(j, 0.0) + w
        weight.setdefault(j, {})[i] = weight.setdefault(j, {}).get(i, 0.0) + w
    member = {n: n for n in weight}
    while True:
        total = sum(sum(x.values()) for x in weight.values()) or 1.0
        degree = {n: sum(x.values()) for n, x in weight.items()}
        home, load = {n: n for n in weight}, dict(degree)
        moved, changed = True, False
        while moved:
            moved = False
            for n in sorted(weight):
                load[home[n]] -= degree[n]
                near: dict[int, float] = {home[n]: 0.0}
                for m, w in weight[n].items():
                    if m != n:
                        near[home[m]] = near.get(home[m], 0.0) + w
                best = min(near, key=lambda c: (-(near[c] - degree[n] * load[c] / total), c != home[n], c))
                gain = near[best] - degree[n] * load[best] / total - (near[home[n]] - degree[n] * load[home[n]] / total)
                if gain > 1e-12:
                    home[n], moved, changed = best, True, True
                load[home[n]] += degree[n]
        member = {n: home[c] for n, c in member.items()}
        if not changed:
            return member
        merged: dict[int, dict[int, float]] = {}
        for n, row in weight.items():
            for m, w in row.items():
                own = merged.setdefault(home[n], {})
                own[home[m]] = own.get(home[m], 0.0) + w
        weight = merged


def _greedy_merges(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Start from single nodes; merge the two linked communities of largest modularity gain while one gains."""
    total = 2.0 * sum(w for i, j, w in edges if i != j) or 1.0
    member, share, between = {}, {}, {}
    for i, j, w in edges:
        for n in (i, j):
            member.setdefault(n, n)
            share.setdefault(n, 0.0)
        if i != j:
            share[i] += w / total
            share[j] += w / total
            for a, b in ((i, j), (j, i)):
                row = between.setdefault(a, {})
                row[b] = row.get(b, 0.0) + w / total
    while True:
        best = max(((2 * (w - share[a] * share[b]), -a, -b) for a, row in between.items() for b, w in row.items() if a < b), default=(0.0, 0, 0))
        if best[0] <= 1e-12:
            return member
        a, b = -best[1], -best[2]
        share[a] += share.pop(b)
        for c, w in between.pop(b).items():
            between[c].pop(b)
            if c != a:
                between[a][c] = between[a].get(c, 0.0) + w
                between[c][a] = between[a][c]
        member = {n: a if c == b else c for n, c in member.items()}


def communities(edges: DataFrame, graph: str, nodes: DataFrame | None = None, method: str = "moves") -> DataFrame:
    """Communities (named by a member) of each graph's nodes by modularity; ``nodes`` (graph, node) adds isolated ones.

    ``method``: "moves" (local moving, then merging, over and over) or "greedy" (only the best merge at a time).
    """
    search = {"moves": _modularity_moves, "greedy": _greedy_merges}[method]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = search(list(zip(pdf["i"], pdf["j"], pdf["weight"], strict=True)))
        return pd.DataFrame({graph: pdf[graph].iloc[0], "node": list(found), "community": list(found.values())})

    kind = edges.schema[graph].dataType.simpleString()
    rows = edges.select(graph, "i", "j", "weight")
    if nodes is not None:  # a loop without weight moves nothing
        rows = rows.unionAll(nodes.select(graph, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("weight")))
    return rows.groupBy(graph).applyInPandas(one, f"{graph} {kind}, node bigint, community bigint")


def label_propagation(edges: DataFrame, nodes: DataFrame, key: str, folder: str) -> DataFrame:
    """Each node takes the label of most weight among its neighbours until no label changes.

    A node keeps its label while no other has more weight, and takes the smaller of
    several. Of neighbours that would change in a round only the smallest does, so
    the weight of edges within labels grows with every change and the rounds end.
    Isolated nodes keep their own label. Weights are positive and compared to nine
    places; each round is written under ``folder``, a place that all executors share.
    """
    spark = nodes.sparkSession
    both = edges.select("i", "j", "weight").unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")).where("i <> j")
    both.write.mode("overwrite").parquet(f"{folder}/edges")
    both = spark.read.parquet(f"{folder}/edges")
    labels, turn = nodes.select(F.col(key).alias("node")).distinct().withColumn("label", F.col("node")), 0
    while True:
        votes = both.join(labels.select(F.col("node").alias("j"), "label"), "j").groupBy(F.col("i").alias("node"), "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        own = labels.withColumnRenamed("label", "old")
        best = votes.join(own, "node").groupBy("node", "old").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b"), F.max(F.when(F.col("label") == F.col("old"), F.col("w"))).alias("kept"))
        asked = best.where(-F.col("b.w") > F.coalesce("kept", F.lit(0.0))).select("node", F.col("b.label").alias("new"))
        asked.write.mode("overwrite").parquet(f"{folder}/asked-{turn}")
        asked = spark.read.parquet(f"{folder}/asked-{turn}")
        if asked.isEmpty():
            return labels
        waits = both.join(asked.select(F.col("node").alias("j")), "j").where("j < i").select(F.col("i").alias("node"))
        moves = asked.join(waits, "node", "left_anti")
        new = labels.join(moves, "node", "left").select("node", F.coalesce("new", "label").alias("label"))
        new.write.mode("overwrite").parquet(f"{folder}/labels-{turn}")
        labels, turn = spark.read.parquet(f"{folder}/labels-{turn}"), turn + 1


def summaries(found: DataFrame, attributes: DataFrame, attribute: str) -> DataFrame:
    """Per community its size, the counts of each value of an attribute, the dominant value, its share; missing nodes are community -1."""
    joined = attributes.join(found, "node", "left").withColumn("community", F.coalesce("community", F.lit(-1)))
    counts = joined.groupBy("community", attribute).agg(F.count("*").alias("n"))
    packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct(attribute, "n"))))
    best = F.min(F.struct((-F.col("n")).alias("n"), attribute))
    return counts.groupBy("community").agg(F.sum("n").alias("size"), packed.alias("counts"), best[attribute].alias("dominant"), (F.max("n") / F.sum("n")).alias("purity"))


def density_clusters(pairs: DataFrame, nodes: DataFrame, key: str, reach: float, min_points: int, components) -> DataFrame:
    """Clusters by density, with a noise class -1.

    ``pairs`` (i, j, distance) holds all pairs within ``reach`` at least. A node with
    ``min_points`` nodes within reach, itself included, is a core; linked cores form a
    cluster, named by its smallest core; other nodes join the nearest core within
    reach (ties: the smaller core), and the rest are noise. ``components`` gives
    the components of (edges, nodes).
    """
    near = pairs.where(F.col("distance") <= reach).select("i", "j", "distance")
    both = near.unionAll(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    every = nodes.select(F.col(key).alias("node")).distinct()
    degree = both.groupBy(F.col("i").alias("node")).agg(F.count("*").alias("n"))
    cores = every.join(degree, "node", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_points).select("node")
    between = near.join(cores.select(F.col("node").alias("i")), "i").join(cores.select(F.col("node").alias("j")), "j").select("i", "j")
    found = components(between, cores).withColumnRenamed("component", "cluster")
    border = both.join(found.select(F.col("node").alias("j"), "cluster"), "j").groupBy(F.col("i").alias("node")).agg(F.min(F.struct("distance", "j", "cluster"))["cluster"].alias("nearest"))
    return every.join(found, "node", "left").join(border, "node", "left").select("node", F.coalesce("cluster", "nearest", F.lit(-1)).alias("cluster"))
