"""Exact top-k search by inner product with KD-trees.

Candidates are dealt into regions of space by median splits that a bounded sample
gives; regions of many rows (copies of one vector fall into one) are cut further by
a hash of the id. Each such shard is one KD-tree: nodes are split at the median of
the widest coordinate and carry tight bounding boxes. No vector in a box scores more
with a query q than ``max(q, 0) . high + min(q, 0) . low``. A search goes through the
nodes best bound first and stops when no bound beats the k-th score found so far.

That k-th score is propagated: a first, cheap round lets every query look into the
best leaf of the few shards whose root boxes promise most; the k-th score found is a
floor. The second, exact round sends a query only to the shards whose root box
reaches its floor, and starts there from it. Root boxes are compared with queries in
packed blocks of both; a task holds one shard's tree and one block of queries.

Scores are exact integers: vectors hold integers, and products are summed in
doubles only while they stay below 2**53, else in 64-bit integers (beyond which no
score of type long exists).

Edge cases: vectors that are null, or hold null or non-finite components, take
no part; of vectors of different lengths the shorter count as filled up with zeros;
ties go to the smaller id; identical vectors are split by position, so that they
can't overfill a leaf; a query is never its own candidate; rows that share an id
are candidates each; fewer candidates than k give all of them; an empty table gives
an empty result; other columns take no part.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilate.llm.common import tidied, written

#: Vectors in a shard and in a leaf, queries in a block, root boxes in a chunk.
SHARD, LEAF, BLOCK, CHUNK = 8192, 128, 4096, 1024
#: Rows that the regions are fitted to, rows of the sample that a region needs, and shards of the first round.
SAMPLE, SUPPORT, FIRST = 20_000, 16, 4


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """Replace the vector by floor(scale * x) of its components; rows without a proper one go."""
    x = F.col(vector).cast("array<double>")
    proper = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(proper, F.lit(False))).withColumn(vector, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")))


def _is_small(a: np.ndarray, b: np.ndarray) -> bool:
    most = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    return most(a) * most(b) * max(a.shape[-1], 1) < 2**53


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each query (row) with each box (column)."""
    q = queries.astype(np.float64)
    bound = np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)
    # where doubles may round, the bound is raised a little
    return bound if _is_small(queries, low) and _is_small(queries, high) else bound * (1 + np.sign(bound) * 1e-9) + 1


class Tree:
    """KD-tree over integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        #: per node: low, high, children (-1: leaf), slice of rows
        self.low, self.high, self.left, self.right, self.begin, self.end = [], [], [], [], [], []
        if len(ids):
            self._grow(np.arange(len(ids)), leaf)
            rows = np.concatenate(self._leaves)
            self.ids, self.vectors = self.ids[rows], self.vectors[rows]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.__dict__.pop("_leaves", None)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        if not hasattr(self, "_leaves"):
            self._leaves, self._placed = [], 0
        node, own = len(self.low), self.vectors[rows]
        low, high = own.min(0), own.max(0)
        for x, v in ((self.low, low), (self.high, high), (self.left, -1), (self.right, -1), (self.begin, self._placed), (self.end, self._placed)):
            x.append(v)
        if len(rows) <= leaf:
            self._leaves.append(np.sort(rows))
            self._placed += len(rows)
        else:
            axis = int((high - low).argmax())
            half = len(rows) // 2
            parted = rows[np.argpartition(own[:, axis], half)]
            self.left[node] = self._grow(parted[:half], leaf)
            self.right[node] = self._grow(parted[half:], leaf)
        self.end[node] = self._placed
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return upper_bounds(queries, self.low, self.high)

    def scores(self, query: np.ndarray, node: int, exact: bool) -> np.ndarray:
        own = self.vectors[self.begin[node] : self.end[node]]
        return (own.astype(np.float64) @ query.astype(np.float64)).astype(np.int64) if exact else own @ query

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, floor: np.ndarray, leaves: int | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query the (score, -id) of its candidates at or above ``floor``, at most k.

        ``leaves`` bounds the leaves that are looked into (first round).
        """
        if not len(self.ids) or not len(queries):
            return
        exact, bound = _is_small(queries, self.vectors), self.bounds(queries)
        for i, name in enumerate(names):
            best: list[tuple[int, int]] = []
            least, seen = floor[i], 0
            queue = [(-bound[i, 0], 0)]
            while queue and (leaves is None or seen < leaves):
                most, node = heapq.heappop(queue)
                if -most < least:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[i, child] >= least:
                            heapq.heappush(queue, (-bound[i, child], child))
                    continue
                seen += 1
                scores = self.scores(queries[i], node, exact)
                for j in np.flatnonzero(scores >= least):
                    own = int(self.ids[self.begin[node] + j])
                    if own == name:
                        continue
                    entry = (int(scores[j]), -own)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    least = max(least, best[0][0])
            yield i, best


class Regions:
    """Regions of space by median splits of a sample; the number of regions is given."""

    def __init__(self, sample: np.ndarray, count: int):
        self.axis, self.cut, self.child, self.count = [], [], [], 0
        self._split(sample, max(1, count))
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut, float), np.array(self.child)

    def _split(self, rows: np.ndarray, count: int) -> int:
        """A node: an axis, a cut and two children; a region's axis is -1 and its first child is its number."""
        at = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.child.append((self.count, 0))
        spread = rows.max(0) - rows.min(0) if len(rows) > 1 else np.zeros(1)
        if count > 1 and spread.max() > 0:
            axis = int(spread.argmax())
            x = np.sort(rows[:, axis])
            cut = x[len(x) * (count // 2) // count]
            if cut == x[0]:
                cut = x[np.searchsorted(x, cut, "right")]
            below = rows[:, axis] < cut
            self.axis[at], self.cut[at] = axis, float(cut)
            left = self._split(rows[below], count // 2)
            right = self._split(rows[~below], count - count // 2)
            self.child[at] = (left, right)
        else:
            self.count += 1
        return at

    def of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        while True:
            inner = self.axis[node] >= 0
            if not inner.any():
                return self.child[node, 0]
            at = np.flatnonzero(inner)
            n = node[at]
            node[at] = self.child[n, (vectors[at, self.axis[n]] >= self.cut[n]).astype(np.int64)]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; the limit per group applies before the shuffle, too."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Index:
    """Trees of all shards and packed chunks of their root boxes, as written tables."""

    def __init__(self, source: DataFrame, shard: int, leaf: int):
        """``source``: vec_id and v, integer vectors of one length."""
        rows = source.count()
        sample = source.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"]
        fitted = np.stack(sample.to_numpy()).astype(np.int64) if len(sample) else np.zeros((0, 1), np.int64)
        regions = Regions(fitted, min(-(-rows // shard), max(1, len(fitted) // SUPPORT)))

        def assign(batches):
            for pdf in batches:
                yield pdf.assign(region=regions.of(_matrix(pdf["v"])).astype(np.int32)) if len(pdf) else pdf.assign(region=pd.Series([], dtype="int32"))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = Tree(pdf["vec_id"].to_numpy(), _matrix(pdf["v"]), leaf)
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()], "tree": [pickle.dumps(tree, protocol=5)]})

        dealt = written(source.select("vec_id", "v").mapInPandas(assign, "vec_id bigint, v array<bigint>, region int"))
        # at most SAMPLE / SUPPORT regions
        pieces = F.broadcast(dealt.groupBy("region").agg(F.ceil(F.count("*") / shard).alias("pieces")))
        number = F.col("region").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))
        self.trees = written(dealt.join(pieces, "region").select("vec_id", "v", number.alias("shard")).groupBy("shard").applyInPandas(grow, "shard bigint, low array<bigint>, high array<bigint>, tree binary"))
        self.shards = self.trees.count()
        chunks = max(1, -(-self.shards // CHUNK))
        pack = lambda pdf: pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "roots": [pickle.dumps((pdf["shard"].to_numpy(), _matrix(pdf["low"]), _matrix(pdf["high"])), protocol=5)]})
        self.chunks, numbered = chunks, self.trees.select("shard", "low", "high", F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int").alias("chunk"))
        self.roots = written(numbered.groupBy("chunk").applyInPandas(pack, "chunk int, roots binary"))

    def visits(self, queries: DataFrame, blocks: int, most: int | None = None) -> DataFrame:
        """(query_id, shard) for the shards whose root box reaches a query's floor, at most ``most`` per query: those of the best bounds."""

        def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": [pickle.dumps((pdf["query_id"].to_numpy(), _matrix(pdf["v"]), pdf["floor"].to_numpy()), protocol=5)]})

        def compare(batches):
            for pdf in batches:
                for roots, block in zip(pdf["roots"], pdf["block"], strict=True):
                    (shards, low, high), (names, vectors, floor) = pickle.loads(roots), pickle.loads(block)
                    bound = upper_bounds(vectors, low, high)
                    near = bound >= floor[:, None]
                    if most is not None and len(shards) > most:
                        near &= bound >= -np.partition(-bound, most - 1, axis=1)[:, most - 1 : most]
                    i, j = np.nonzero(near)
                    yield pd.DataFrame({"query_id": names[i], "shard": shards[j], "bound": bound[i, j]})

        packed = queries.withColumn("b", F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(blocks)).cast("int")).groupBy("b").applyInPandas(bundle, "block binary")
        # the stated queries against all root boxes, in blocks
        spread = packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("chunk"))
        found = self.roots.join(spread, "chunk").mapInPandas(compare, "query_id bigint, shard bigint, bound double")
        if most is not None:
            order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard")
            found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
        return found.select("query_id", "shard")

    def search(self, queries: DataFrame, visits: DataFrame, k: int, blocks: int, leaves: int | None) -> DataFrame:
        """Candidates of each query in the shards that it visits, at most k of each."""

        def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "block": [pickle.dumps((pdf["query_id"].to_numpy(), _matrix(pdf["v"]), pdf["floor"].to_numpy()), protocol=5)]})

        def one(batches):
            for pdf in batches:
                out = []
                for tree, block in zip(pdf["tree"], pdf["block"], strict=True):
                    tree, (names, vectors, floor) = pickle.loads(tree), pickle.loads(block)
                    for i, best in tree.search(vectors, names, k, floor, leaves):
                        out += [(int(names[i]), -own, score) for score, own in best]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

        asked = visits.join(queries, "query_id").withColumn("b", F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(blocks)).cast("int"))
        packed = asked.groupBy("shard", "b").applyInPandas(bundle, "shard bigint, block binary")
        return self.trees.select("shard", "tree").join(packed, "shard").mapInPandas(one, "query_id bigint, vec_id bigint, score bigint")


@tidied
def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """The k candidates of highest inner product for each query among all other rows.

    ``vectors`` holds integer vectors (see ``quantised``).
    """
    source = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL")
    dims = source.agg(F.max(F.size("v"))).first()[0] or 0
    source = written(source.withColumn("v", F.when(F.size("v") < dims, F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("v")))).otherwise(F.col("v"))).where(F.size("v") > 0))
    queries = source.where("asks").select(F.col("vec_id").alias("query_id"), "v").withColumn("floor", F.lit(-(2**63)))
    blocks, index = max(1, -(-queries.count() // block)), Index(source, shard, leaf)
    first = _best(index.search(queries, index.visits(queries, blocks, FIRST), k, blocks, 1), k)
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    known = written(queries.join(floors, "query_id", "left").select("query_id", "v", F.coalesce("reached", "floor").alias("floor")))
    return _best(index.search(known, index.visits(known, blocks), k, blocks, None), k)
