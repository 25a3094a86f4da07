"""N-gram Jaccard join by vertical partitioning, and the components of its links.

A document's set holds the hashes of its distinct word n-grams. Two documents
link when the Jaccard similarity of their sets reaches a threshold.

1. One pass over the texts deals the n-grams of every distinct set out by hash,
   packed: of each n-gram six bytes, and the set's 64-bit signature once for all
   its n-grams of a part. Sets that are equal within a batch go once. N-grams of
   very many sets of a batch are announced to their part without owners and go
   straight to the owners, so that no part holds the owners of a hot passage.
2. Each part counts in how many sets its n-grams are. N-grams of one set can't
   link anything and go no further than as a number; the others return to their
   sets. The counts, then the hashes, give one global order, rare ones first.
3. Linked sets share an n-gram among the first ``n - ceil(t n) + 1`` of each. A set
   whose prefix is filled by n-grams of its own has no partner and is done; the
   others enter the inverted lists of their prefixes, and their n-grams are cut
   into segments at fixed places of the global order.
4. Candidate pairs come from the lists, by length and positional filters. Lists of
   near copies would give all their pairs, so lists are reduced first: every
   member is paired only with the list's centre (the set with the fewest n-grams
   of its own, which is what copies were made from), linked members merge into
   components, and a list that lies in one component needs no more pairs. All
   pairs of different components in the lists left follow. So no link between
   components is lost.
5. Pairs are verified by vertical partitioning: for every fragment of the global
   order the overlap of a pair's segments is counted on its own; the sum over
   fragments is the overlap.

Nothing that grows with the corpus is collected or broadcast. N-grams are known
by at least 52 bits of a hash (48 and those of the part; 54 from 33 shuffle partitions on), sets in the lists by 64, equal sets by 128.

Edge cases: null and empty texts have an empty set and link with nothing; texts
of fewer words than ``gram`` have their whole sequence as one n-gram; repeated
rows are equal sets; rows without an id get no component and join none; of two
texts under one id each is a member of its own links, and both rows carry the id;
an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import col
from pyspark.sql.pandas.types import to_arrow_type

from quilate.llm.common import discarded, mix64, tidied, unused, written
from quilate.llm.hashing import Block, Blocks, signed

GRAM = 5
#: Similarity as a fraction.
THRESHOLD = (4, 5)
#: Fragments of the global order, and most rounds of centres.
FRAGMENTS, ROUNDS = 8, 6
#: N-grams packed at a time, and sets of such a batch from which an n-gram counts as hot.
HELD, HOT = 1 << 20, 32
_HOT_LEVEL = 255
_DOC, _GRAMS, _SHARED, _LEVELS = range(4)


def _sets(block: Block, gram: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a block."""
    grams, short, out = block.windows(gram), {}, []
    for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
        if b - a >= gram:
            own = np.sort(grams[a : b - gram + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            if b - a not in short:
                short[b - a] = block.windows(b - a)
            out.append(short[b - a][a : a + 1])
        else:
            out.append(grams[:0])
    return out


class _Parts:
    """Parts of the hash space, two to the power of ``bits``, and a key for each that Spark deals to a partition of its own."""

    def __init__(self, spark: SparkSession):
        self.bits = min(16, max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
        self.count = 1 << self.bits
        at = spark.range(16 * self.count, numPartitions=1).select(col("id").cast("int").alias("k"), F.pmod(F.hash(col("id").cast("int")), F.lit(self.count)).alias("p"))
        found = {r.p: r.k for r in at.groupBy("p").agg(F.min("k").alias("k")).collect()}
        self.keys = np.array([found.get(p, p) for p in range(self.count)], np.int32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.uint16)

    def whole(self, part: int, low: np.ndarray) -> np.ndarray:
        """N-grams as 64-bit numbers from their part and six bytes."""
        return low | (np.uint64(part) << np.uint64(48))


def _six(x: np.ndarray) -> np.ndarray:
    """The low six bytes of each number, as a matrix of bytes."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view("<u8")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


class _Rows:
    """Collects rows of the packed exchange as Arrow batches."""

    def __init__(self, kind: pa.DataType):
        self.schema = pa.schema([("kind", pa.int8()), ("at", pa.int32()), ("part", pa.int32()), ("id", kind), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("owners", pa.binary()), ("lens", pa.binary()), ("grams", pa.binary()), ("level", pa.binary())])
        self.kind = kind

    def documents(self, at, ids, n, c1, c2) -> pa.RecordBatch:
        k = len(n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, _DOC, np.int8)), pa.array(at), pa.nulls(k, pa.int32()), ids, pa.array(n), pa.array(signed(c1)), pa.array(signed(c2)), *[pa.nulls(k, pa.binary())] * 4], schema=self.schema)

    def packed(self, rows: list[tuple]) -> pa.RecordBatch:
        """rows: (kind, at, part, owners, lens, grams, level)"""
        kind, at, part, owners, lens, grams, level = zip(*rows, strict=True)
        k, none = len(rows), pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(at, pa.int32()), pa.array(part, pa.int32()), pa.nulls(k, self.kind), none, none, none, *[pa.array(x, pa.binary()) for x in (owners, lens, grams, level)]], schema=self.schema)


def _schema(kind: str) -> str:
    return f"kind tinyint, at int, part int, id {kind}, n bigint, c1 bigint, c2 bigint, owners binary, lens binary, grams binary, level binary"


def _by_owner(kind: int, at: np.ndarray, part: int, owner: np.ndarray, gram: np.ndarray, level: np.ndarray, bits: int) -> list[tuple]:
    """Rows for the owners' parts; ``gram`` as a matrix of bytes."""
    order = np.argsort(owner, kind="stable")
    owner, gram, level = owner[order], gram[order], level[order]
    runs = _runs(owner)
    first, lens = owner[runs[:-1]], np.diff(runs).astype("<u4")
    place = (first >> np.uint64(64 - bits)).astype(np.int64)
    edges, out = _runs(place), []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        x, y = int(runs[a]), int(runs[b])
        out.append((kind, int(at[place[a]]), part, first[a:b].tobytes(), lens[a:b].tobytes(), gram[x:y].tobytes(), level[x:y].tobytes()))
    return out


def _scan(docs: DataFrame, key: str, text: str, gram: int, parts: _Parts) -> DataFrame:
    """A row per document (size and signature of its set), and the packed n-grams of distinct sets by part."""
    rows = _Rows(to_arrow_type(docs.schema[key].dataType))

    def pack(sets: list[np.ndarray], c1: np.ndarray, c2: np.ndarray):
        one = {(x, y): i for i, (x, y) in reversed(list(enumerate(zip(c1.tolist(), c2.tolist(), strict=True))))}
        use = sorted(i for i in one.values() if len(sets[i]))
        if not use:
            return
        every, owner = np.concatenate([sets[i] for i in use]), np.repeat(np.array(use), [len(sets[i]) for i in use])
        # n-grams of very many sets: buckets of the hash first, then exactly
        bucket = (every & np.uint64((1 << 20) - 1)).astype(np.int64)
        full = np.flatnonzero(np.bincount(bucket, minlength=1 << 20)[bucket] >= HOT)
        v, k = np.unique(every[full], return_counts=True)
        hot = v[k >= HOT]
        out = []
        if len(hot):
            at = full[hot[np.minimum(np.searchsorted(hot, every[full]), len(hot) - 1)] == every[full]]
            whole = parts.of(every[at]).astype(np.uint64) << np.uint64(48) | every[at] & np.uint64((1 << 48) - 1)
            out += _by_owner(_SHARED, parts.keys, -1, c1[owner[at]], whole.astype("<u8").view(np.uint8).reshape(-1, 8), np.full(len(at), _HOT_LEVEL, np.uint8), parts.bits)
            stay = np.ones(len(every), bool)
            stay[at] = False
            every, owner = every[stay], owner[stay]
        part = parts.of(every)
        order = np.argsort(part, kind="stable")
        part, owner, low = part[order], owner[order], _six(every[order])
        runs = _runs(part, owner)
        first, names, lens = part[runs[:-1]], c1[owner[runs[:-1]]], np.diff(runs).astype("<u4")
        edges, news = _runs(first), {}
        for p in np.unique(parts.of(hot)).tolist():
            news[p] = _six(hot[parts.of(hot) == p]).tobytes()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            p = int(first[a])
            out.append((_GRAMS, int(parts.keys[p]), p, names[a:b].tobytes(), lens[a:b].tobytes(), low[int(runs[a]) : int(runs[b])].tobytes(), news.pop(p, b"")))
        out += [(_GRAMS, int(parts.keys[p]), p, b"", b"", b"", x) for p, x in news.items()]
        yield rows.packed(out)

    def run(batches):
        blocks, sets, c1, c2, held, turn = Blocks(True), [], [], [], 0, 0
        for batch in batches:
            for at, block in blocks.of(batch.column(1)):
                own = _sets(block, gram)
                with np.errstate(over="ignore"):
                    x1 = np.array([s.sum(dtype=np.uint64) for s in own], np.uint64)
                    x2 = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in own], np.uint64)
                n = np.array([len(s) for s in own], np.int64)
                yield rows.documents(parts.keys[(turn + np.arange(len(own))) % parts.count], batch.column(0).slice(at.start, len(own)), n, x1, x2)
                turn += len(own)
                sets += own
                c1.append(x1)
                c2.append(x2)
                held += int(n.sum())
                if held >= HELD:
                    yield from pack(sets, np.concatenate(c1), np.concatenate(c2))
                    sets, c1, c2, held = [], [], [], 0
        if sets:
            yield from pack(sets, np.concatenate(c1), np.concatenate(c2))

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, _schema(docs.schema[key].dataType.simpleString()))


def _level(count: np.ndarray) -> np.ndarray:
    """Four steps per doubling, in a byte."""
    return np.minimum(4 * np.log2(count), _HOT_LEVEL - 1).astype(np.uint8)


def _counted(scanned: DataFrame, parts: _Parts, kind) -> DataFrame:
    """Documents as they come; of the n-grams those that are in two sets or more, by owner; the numbers of them by level."""
    rows = _Rows(to_arrow_type(kind))

    def reduce(part: int, owners: list, lens: list, grams: list, news: list):
        g, owner = _from_six(grams), np.repeat(np.frombuffer(b"".join(owners), "<u8"), np.frombuffer(b"".join(lens), "<u4"))
        hot = np.unique(_from_six(news))
        is_hot = lambda x: hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x if len(hot) else np.zeros(len(x), bool)
        order = np.argsort(g)
        g, owner = g[order], owner[order]
        runs = _runs(g)
        many = np.repeat(np.diff(runs) > 1, np.diff(runs)) | is_hot(g)
        g, owner = g[many], owner[many]
        order = np.lexsort((owner, g))
        g, owner = g[order], owner[order]
        first = _runs(g, owner)[:-1]
        g, owner = g[first], owner[first]
        runs = _runs(g)
        size = np.diff(runs)
        level = np.where(is_hot(g[runs[:-1]]), _HOT_LEVEL, _level(np.maximum(size, 1)))
        level, size = np.repeat(level, size).astype(np.uint8), np.repeat(size, size)
        stay = (size > 1) | (level == _HOT_LEVEL)
        if stay.any():
            tally = np.bincount(level[stay], minlength=256).astype("<i8")
            yield rows.packed([*_by_owner(_SHARED, parts.keys, part, owner[stay], _six(g[stay]), level[stay], parts.bits), (_LEVELS, 0, None, None, None, tally.tobytes(), None)])

    def run(batches):
        waiting: dict[int, tuple[list, ...]] = {}
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            mine = kinds == _GRAMS
            if not mine.all():
                yield batch.filter(pa.array(~mine))
            for i in np.flatnonzero(mine).tolist():
                lists = waiting.setdefault(batch.column(2)[i].as_py(), ([], [], [], []))
                for x, c in zip(lists, (7, 8, 9, 10), strict=True):
                    x.append(batch.column(c)[i].as_py())
        while waiting:
            part, lists = waiting.popitem()
            yield from reduce(part, *lists)

    return scanned.repartition(parts.count, "at").mapInArrow(run, scanned.schema)


def _pivots(mass: np.ndarray, fragments: int) -> list[tuple[int, int]]:
    """(level, n-gram) at which the fragments after the first begin; each fragment has about the same mass."""
    sums, out = np.concatenate([[0.0], np.cumsum(mass.astype(float))]), []
    for k in range(1, fragments):
        want = sums[-1] * k / fragments
        level = max(min(int(np.searchsorted(sums, want, "right")) - 1, 255), 0)
        share = (want - sums[level]) / mass[level] if mass[level] else 0.0
        out.append((level, int(min(share, 1.0) * (2**64 - 2**11))))
    return out


def _prefix_length(n: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    a, b = threshold
    return n - -(-a * n // b) + 1


def _candidates(shared: DataFrame, classes: DataFrame, pivots: list[tuple[int, int]], parts: _Parts, kind, threshold: tuple[int, int]) -> DataFrame:
    """Of sets with room for shared n-grams in their prefix: list entries (f null) and segments (f and s)."""
    type_ = to_arrow_type(kind)
    names = ["v", "rep", "n", "i", "u", "f", "s"]
    keys = "array({})".format(",".join(map(str, parts.keys.tolist())))
    place = F.expr(f"{keys}[cast(shiftrightunsigned(c1, {64 - parts.bits}) AS int)]")
    own = classes.select(F.lit(_DOC).cast("tinyint").alias("kind"), place.alias("at"), F.lit(None).cast("int").alias("part"), col("rep").alias("id"), "n", "c1", "c2", *[F.lit(None).cast("binary").alias(x) for x in ("owners", "lens", "grams", "level")])

    def run(batches):
        classes, owners, grams, levels = [], [], [], []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds == _DOC).any():
                classes.append(batch.filter(pa.array(kinds == _DOC)).select([3, 4, 5]))
            for i in np.flatnonzero(kinds == _SHARED).tolist():
                part, raw = batch.column(2)[i].as_py(), batch.column(9)[i].as_py()
                grams.append(parts.whole(part, _from_six([raw])) if part >= 0 else np.frombuffer(raw, "<u8"))
                owners.append(np.repeat(np.frombuffer(batch.column(7)[i].as_py(), "<u8"), np.frombuffer(batch.column(8)[i].as_py(), "<u4")))
                levels.append(np.frombuffer(batch.column(10)[i].as_py(), np.uint8))
        if not grams or not classes:
            return
        table = pa.Table.from_batches(classes).combine_chunks()
        signature = table.column(2).to_numpy().view(np.uint64)
        by = np.argsort(signature)
        g, owner, level = np.concatenate(grams), np.concatenate(owners), np.concatenate(levels)
        del grams, owners, levels
        order = np.lexsort((g, level, owner))
        g, owner, level = g[order], owner[order], level[order]
        # a hot n-gram may come from more than one batch
        first = _runs(owner, level, g)[:-1]
        g, owner, level = g[first], owner[first], level[first]
        runs = _runs(owner)
        at = by[np.searchsorted(signature[by], owner[runs[:-1]])]
        n, m = table.column(1).to_numpy()[at], np.diff(runs)
        alone = n - m
        slots = np.minimum(_prefix_length(n, threshold) - alone, m)
        some = np.flatnonzero(slots > 0)
        for few in np.array_split(some, max(1, len(some) // 2000)):
            if not len(few):
                continue
            start, k = runs[:-1][few], slots[few]
            rank = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            yield batch_of(g[np.repeat(start, k) + rank], table.column(0).take(pa.array(np.repeat(at[few], k))), np.repeat(n[few], k), np.repeat(alone[few], k) + rank, np.repeat(alone[few], k), None, None)
            who, fragment, segment = [], [], []
            for j in few.tolist():
                a, b = int(runs[j]), int(runs[j + 1])
                cuts = [a]
                for lv, v in pivots:
                    x, y = a + np.searchsorted(level[a:b], lv), a + np.searchsorted(level[a:b], lv, "right")
                    cuts.append(int(x + np.searchsorted(g[x:y], np.uint64(v))))
                for f, (x, y) in enumerate(zip(cuts, [*cuts[1:], b], strict=True)):
                    if y > x:
                        who.append(int(at[j]))
                        fragment.append(f)
                        segment.append(signed(g[x:y]))
            yield batch_of(None, table.column(0).take(pa.array(who, pa.int64())), None, None, None, np.array(fragment, np.int32), pa.array(segment, pa.list_(pa.int64())))

    def batch_of(v, rep, n, i, u, f, s):
        rep = rep.combine_chunks() if isinstance(rep, pa.ChunkedArray) else rep
        whole = lambda x, t: pa.nulls(len(rep), t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t)
        return pa.RecordBatch.from_arrays([whole(None if v is None else signed(v), pa.int64()), rep.cast(type_), whole(n, pa.int64()), whole(i, pa.int64()), whole(u, pa.int64()), whole(f, pa.int32()), whole(s, pa.list_(pa.int64()))], names)

    both = shared.unionByName(own).repartition(parts.count, "at")
    return both.mapInArrow(run, f"v bigint, rep {kind.simpleString()}, n bigint, i bigint, u bigint, f int, s array<bigint>")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ``overlap`` to pairs (a, b): partial overlaps of each fragment, summed per pair.

    A repeated row repeats its segments, so a fragment counts once.
    """
    left = segments.select(col("id").alias("a"), "f", col("s").alias("sa"))
    right = segments.select(col("id").alias("b"), "f", col("s").alias("sb"))
    partial = pairs.join(left, "a").join(right, ["b", "f"]).select(*pairs.columns, "f", F.size(F.array_intersect("sa", "sb")).alias("o"))
    return partial.groupBy(*pairs.columns, "f").agg(F.max("o").alias("o")).groupBy(*pairs.columns).agg(F.sum("o").alias("overlap"))


def linked(pairs: DataFrame, segments: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b, na, nb, ...) whose similarity reaches the threshold."""
    p, q = threshold
    return overlaps(pairs, segments).where(q * col("overlap") >= p * (col("na") + col("nb") - col("overlap")))


def components(edges: DataFrame) -> DataFrame:
    """Component of each node of undirected edges (a, b): columns node, component (its smallest node).

    Alternates the large-star and the small-star step on the edges until they
    stay as they are; each step is an aggregate and a join, so that a node of very
    many edges is split like any skewed key.
    """
    edges = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(col("v").alias("u"), col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(col("m").alias("u"), "v").where("u <> v").distinct()
        # every node points to its least smaller neighbour, and so do the others
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        before, edges = edges, written(joined.select(col("m").alias("u"), "v").unionAll(joined.where("u <> m").select(col("m").alias("u"), col("u").alias("v"))).where("u <> v").distinct())
        discarded(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(col("u").alias("node"), col("u").alias("component")).distinct()
    return edges.select(col("v").alias("node"), col("u").alias("component")).unionAll(roots)


@tidied
def component_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per document its id, n_shingles and component_id."""
    (p, q), spark = threshold, docs.sparkSession
    kind, parts = docs.schema[key].dataType, _Parts(spark)
    counted = written(_counted(_scan(docs, key, text, gram, parts), parts, kind))
    sets = counted.where(f"kind = {_DOC}").select("id", "n", "c1", "c2")
    mass = np.zeros(256)
    for row in counted.where(f"kind = {_LEVELS}").select("grams").toLocalIterator():
        mass += np.frombuffer(row.grams, "<i8")
    classes = written(sets.where("n > 0 AND id IS NOT NULL").groupBy("n", "c1", "c2").agg(F.min("id").alias("rep")))
    found = written(_candidates(counted.where(f"kind = {_SHARED}"), classes, _pivots(mass, FRAGMENTS), parts, kind, threshold))
    sets = written(sets)
    discarded(counted)
    segments = found.where("f IS NOT NULL").select(col("rep").alias("id"), "f", "s")
    lists = found.where("f IS NULL").select("v", "rep", "n", "i", "u", col("rep").alias("comp"))

    fits = lambda na, ia, nb, ib: (q * na >= p * nb) & (q * nb >= p * na) & ((p + q) * F.least(na - ia, nb - ib) >= p * (na + nb))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        links = written(linked(pairs, segments, threshold).select("a", "b", "ca", "cb"))
        discarded(pairs)
        return links

    every = None
    for _ in range(ROUNDS):
        centre = F.min(F.struct("u", "rep", "n", "i", "comp")).alias("m")
        open_ = lists.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), centre).where("low <> high").select("v", "m")
        met = lists.join(open_, "v").where(col("comp") != col("m.comp")).where(fits(col("n"), col("i"), col("m.n"), col("m.i")))
        pairs = met.select(col("rep").alias("a"), col("m.rep").alias("b"), col("n").alias("na"), col("m.n").alias("nb"), col("comp").alias("ca"), col("m.comp").alias("cb")).distinct()
        links = verified(pairs)
        if links.isEmpty():
            break
        every = links if every is None else every.unionAll(links)
        # lists that lie in one component are done, and each component of a list is known by one label
        merged = written(components(links.select(col("ca").alias("a"), col("cb").alias("b"))))
        labelled = lists.join(open_.select("v"), "v").join(merged.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).select(*lists.columns)
        left = written(labelled)
        lists = left.join(left.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("v"), "v")
        asked = lists.groupBy("v", "comp").agg(F.count("*").cast("double").alias("k")).groupBy("v").agg(F.sum("k").alias("t"), F.sum(col("k") * col("k")).alias("s"))
        total = asked.agg(F.sum((col("t") * col("t") - col("s")) / 2), F.sum("t")).first()
        if not total[0] or total[0] <= 8 * total[1]:
            break
    side = lambda x: lists.select("v", col("rep").alias(x), col("n").alias(f"n{x}"), col("i").alias(f"i{x}"), col("comp").alias(f"c{x}"))
    met = side("a").join(side("b"), "v").where((col("ca") < col("cb")) & fits(col("na"), col("ia"), col("nb"), col("ib")))
    # what both have behind the last n-gram that their prefixes share bounds the overlap, too
    pairs = met.groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.count("*").alias("k"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    most = col("k") + F.least(col("na") - col("ia"), col("nb") - col("ib")) - 1
    links = verified(pairs.where(q * most >= p * (col("na") + col("nb") - most)).select("a", "b", "na", "nb", "ca", "cb"))
    every = links if every is None else every.unionAll(links)
    labels = written(components(every.select("a", "b")))
    member = sets.join(classes, ["n", "c1", "c2"], "left").join(labels, col("rep") == col("node"), "left")
    return member.select(col("id").alias(key), col("n").alias("n_shingles"), F.when(col("id").isNotNull(), F.coalesce("component", "rep", "id")).cast(kind).alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The documents whose id is the smallest of its component, with all their columns.

    Rows without an id stay. Of rows that share an id all stay if one of them is a
    leader, else none.
    """
    ids, one = component_ids(docs.select(f"`{key}`", f"`{text}`"), key, text, gram, threshold), unused(docs, "leader")
    followers = ids.where(col(key).isNotNull()).groupBy(col(key).alias(one)).agg(F.max(col(key) == col("component_id")).alias("leads")).where("NOT leads").select(one)
    return docs.join(followers, col(key) == col(one), "left_anti")
