"""Ranked lexical search over a tiered index of impacts.

A term's impact in a document is an integer that grows with how often the document
has it and falls with the document's length; a document's score for an item is the
sum of weight times impact over the item's terms. The index is made of shards of a
bounded number of documents, a row each. Within a shard each term's postings are
ordered by impact and cut into tiers: the first holds the highest ones (all of a rare
term's), the last the rest. With each tier but the last goes a bound per term: no
posting in lower tiers has a higher impact.

A search reads tiers from the top. What the tiers read so far give a document is a
lower bound of its score; adding the bounds of the terms that it wasn't seen with gives
an upper one. The k-th best lower bound over all shards is the least that a result must
reach. An item is proven in a shard when every document whose upper bound reaches that
has an exact score; then its exact best documents there are final. Pairs of item and
shard without that proof fall through and are worked on again with the next tier, and
only their shards are read, with the columns of the tiers needed. The last tier leaves
no doubt. Whatever the tiers, results are exact.

Items meet shards in blocks of bounded size; all documents are indexed and all items
searched. Results of shards are cut to the k best before they are ranked.

Edge cases: null and empty texts have no terms, count for nothing and are never found;
very long texts are indexed whole; repeated rows are documents each, and rank one after
the other under one id; rows without an id rank behind others of the same score; items
that repeat with their text are one item, different texts under one id are items of
their own; items without a term that occurs give no rows; empty tables give an empty
result; extra columns take no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import col
from pyspark.sql.pandas.types import to_arrow_type

from quilate.llm.common import settings, tidied, written

#: Fixed value: the characters of a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents and occurrences of terms in a shard, items in a block.
DOCUMENTS, OCCURRENCES, ITEMS = 4096, 1 << 21, 256
#: Shards in a file, which a reader takes at once, and bytes in a batch for Python (or one shard): bounds of memory.
SHARDS, BATCH = 4, {"spark__sql__execution__arrow__maxBytesPerBatch": "8m"}
#: Each tier but the last holds a term's so many best postings at least, and this share of them.
TIERS = ((32, 1 / 16), (256, 1 / 4))
_EXACT, _LOW, _OPEN = range(3)
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    n = F.coalesce(F.regexp_count(col(text), F.lit(TERM)), F.lit(0)).cast("bigint")
    some, every = docs.select(n.alias("n")).agg(F.count_if(col("n") > 0), F.sum("n")).first()
    return some, every or 0


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Shard:
    """Documents of a shard as they come."""

    def __init__(self):
        self.keys, self.found, self.numbers, self.held = [], [], _Numbers(), 0

    def add(self, key: object, text: str | None) -> None:
        own = terms_of(text) if text else []
        self.keys.append(key)
        self.found.append(np.fromiter(map(self.numbers.__getitem__, own), np.int32, len(own)))
        self.held += len(own)

    def row(self, shard: int, totals: tuple[int, int], tiers: tuple[tuple[int, float], ...]) -> dict[str, object]:
        lengths, width = np.array([len(x) for x in self.found], np.int64), max(1, len(self.numbers))
        m = 100 - 25 + 25 * lengths * totals[0] // max(1, totals[1])
        # one array of occurrences, sorted in place; a shard is large, so few others of its size
        postings = np.concatenate(self.found, dtype=np.int64)
        self.found = []
        postings += np.repeat(np.arange(len(lengths)) * width, lengths)
        postings.sort()
        first = np.flatnonzero(np.diff(postings, prepend=-1))
        tf = np.diff(first, append=len(postings))
        postings = postings[first]
        del first
        document = (postings // width).astype(np.int32)
        postings %= width
        strength = impact(tf, m[document]).astype(np.int32)
        order = np.argsort(postings << 20 | (1_000_000 - strength), kind="stable")
        document, term, tf, strength = document[order], postings[order], tf[order].astype(np.int32), strength[order]
        del order, postings
        held = np.bincount(term, minlength=len(self.numbers))
        place = np.arange(len(term)) - np.repeat(np.cumsum(held) - held, held)
        ends = [np.minimum(held, np.maximum(least, (share * held).astype(np.int64))) for least, share in tiers] + [held]
        row = {"shard": shard, "keys": self.keys, "m": m.astype("<i8").tobytes(), "terms": [t.decode() for t in self.numbers], "held": held}
        begin, starts = np.zeros(len(held), np.int64), np.cumsum(held) - held
        for k, end in enumerate(ends):
            own = (place >= begin[term]) & (place < end[term])
            after = np.zeros(len(held), np.int64)
            more = end < held
            after[more] = strength[(starts + end)[more]]
            row |= {f"widths{k}": (end - begin).astype("<u4").tobytes(), f"docs{k}": document[own].astype("<u4").tobytes(), f"tfs{k}": tf[own].astype("<u4").tobytes(), f"after{k}": after.astype("<u4").tobytes()}
            begin = end
        return row


def _tier_columns(k: int) -> list[str]:
    return [f"{c}{k}" for c in ("widths", "docs", "tfs", "after")]


def index(docs: DataFrame, counted: tuple[int, int], key: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, tiers: tuple[tuple[int, float], ...] = TIERS) -> DataFrame:
    """The tiered index, a row per shard; ``counted`` comes from ``totals``."""
    source = docs.select(f"`{key}`", f"`{text}`")
    kind = source.schema[key].dataType
    packed = ["m", *(c for k in range(len(tiers) + 1) for c in _tier_columns(k))]
    schema = f"shard bigint, keys array<{kind.simpleString()}>, terms array<string>, held array<bigint>, {', '.join(f'{c} binary' for c in packed)}"
    types = {"shard": pa.int64(), "keys": pa.list_(to_arrow_type(kind)), "terms": pa.list_(pa.string()), "held": pa.list_(pa.int64())} | dict.fromkeys(packed, pa.binary())

    def run(batches):
        number, own = TaskContext.get().partitionId() << 32, _Shard()

        def out() -> pa.RecordBatch:
            row = own.row(number, counted, tiers)
            return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in types.items()], list(types))

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.add(k, x.as_py())
                if len(own.keys) >= documents or own.held >= OCCURRENCES:
                    yield out()
                    number, own = number + 1, _Shard()
        if own.keys:
            yield out()

    return source.mapInArrow(run, schema)


def stored(shards: DataFrame) -> DataFrame:
    """The index, written in files of a few shards: a reader takes the rows of a file in batches of thousands."""
    with settings(shards.sparkSession, **BATCH):
        return written(shards, maxRecordsPerFile=SHARDS)


class _Reader:
    """The tiers of a shard that were read."""

    def __init__(self, row: dict[str, object], tiers: int):
        self.keys, self.number = row["keys"], {t: i for i, t in enumerate(row["terms"])}
        self.m = np.frombuffer(row["m"], "<i8")
        self.tiers = []
        for k in range(tiers):
            widths, docs, tfs, after = (np.frombuffer(row[c], "<u4") for c in _tier_columns(k))
            self.tiers.append((np.concatenate([[0], np.cumsum(widths, dtype=np.int64)]), docs, tfs, after))
        # places of the ids in ascending order, nulls last
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i] is None, self.keys[i]))
        self.order = np.empty(len(order), np.int64)
        self.order[order] = np.arange(len(order))
        self.seen: dict[str, tuple[np.ndarray, np.ndarray, int] | None] = {}

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Documents, impacts and the bound of what wasn't read."""
        if term not in self.seen:
            i = self.number.get(term)
            if i is None:
                self.seen[term] = None
            else:
                cut = [(docs[ends[i] : ends[i + 1]], tfs[ends[i] : ends[i + 1]]) for ends, docs, tfs, _ in self.tiers]
                docs, tfs = (np.concatenate(x, dtype=np.int64) for x in zip(*cut, strict=True))
                self.seen[term] = docs, impact(tfs, self.m[docs]), int(self.tiers[-1][3][i])
        return self.seen[term]

    def judge(self, terms: list[dict[str, object]], least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Scores so far, the best exact documents, the best others, and the highest upper bound of those in doubt (0: proven)."""
        score, seen, rest = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64), 0
        for x in terms:
            if found := self.postings(x["term"]):
                docs, strength, after = found
                score[docs] += x["weight"] * strength
                if after:
                    seen[docs] += x["weight"] * after
                    rest += x["weight"] * after
        upper = score + (rest - seen)
        exact = upper == score
        if len(score) >= k:
            least = max(least, int(np.partition(score, -k)[-k]))
        doubt = upper[(upper >= least) & ~exact]
        return score, self.best(score, exact, k), self.best(score, ~exact, k), int(doubt.max()) if len(doubt) else 0

    def best(self, score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
        own = np.flatnonzero(among & (score > 0))
        if len(own) > k:
            own = own[score[own] >= np.partition(score[own], -k)[-k]]
        return own[np.lexsort((self.order[own], -score[own]))][:k]


def _level(shards: DataFrame, asked: DataFrame, tier: int, k: int) -> DataFrame:
    """Rows (q, shard, key, score, kind) for pairs of item and shard with the tiers up to ``tier``.

    ``asked``: (shard, items), each item with its number, terms and the score that results must reach.
    """
    kind = shards.schema["keys"].dataType.elementType
    columns = ["keys", "m", "terms", *(c for t in range(tier + 1) for c in _tier_columns(t))]
    joined = shards.select("shard", *columns).join(asked, "shard").select("shard", *columns, "items")
    arrow = {"q": pa.int64(), "shard": pa.int64(), "key": to_arrow_type(kind), "score": pa.int64(), "kind": pa.int8()}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, out = _Reader(row, tier + 1), []
                for item in row["items"]:
                    score, exact, others, doubt = shard.judge(item["terms"], item["least"], k)
                    out += [(item["q"], row["shard"], shard.keys[d], int(score[d]), _EXACT) for d in exact]
                    out += [(item["q"], row["shard"], shard.keys[d], int(score[d]), _LOW) for d in others]
                    if doubt:
                        out.append((item["q"], row["shard"], None, doubt, _OPEN))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), arrow.values(), strict=True)] if out else [pa.array([], t) for t in arrow.values()], list(arrow))

    return joined.mapInArrow(run, f"q bigint, shard bigint, key {kind.simpleString()}, score bigint, kind tinyint")


@tidied
def search(shards: DataFrame, items: DataFrame, counted: tuple[int, int], item: str = "item_id", text: str = "text", key: str = "doc_id", k: int = 20, block: int = ITEMS) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item, rank, key, score.

    ``shards`` is a written index and ``counted`` the totals that it was made with.
    """
    tiers = sum(c.startswith("docs") for c in shards.columns)
    asked = written(items.select(col(item).alias("item"), _lowered(col(text)).alias("text")).distinct().withColumn("q", F.monotonically_increasing_id()))
    own = asked.select("q", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    df = shards.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).select(col("x.terms").alias("term"), col("x.held").alias("held"))
    df = df.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(counted[0]) + 2).cast("double") / (2 * col("df") + 1).cast("double")))
    packed = F.collect_list(F.struct("term", (col("times") * weight).cast("bigint").alias("weight"))).alias("terms")
    wanted = written(own.join(df, "term").groupBy("q").agg(packed))
    blocks = max(1, -(-asked.count() // block))
    number = lambda q: F.pmod(F.xxhash64(q), F.lit(blocks))
    by_block = wanted.groupBy(number("q").alias("b")).agg(F.collect_list(F.struct("q", "terms", F.lit(1).cast("bigint").alias("least"))).alias("items"))
    pairs = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("b")).join(by_block, "b").select("shard", "items")
    best, settled = Window.partitionBy("q").orderBy(col("score").desc()), []
    for tier in range(tiers):
        with settings(shards.sparkSession, **BATCH):
            found = written(_level(shards, pairs, tier, k))
        if tier + 1 == tiers:
            settled.append(found.where(col("kind") == _EXACT))
            break
        known = reduce(DataFrame.unionAll, [*settled, found.where(col("kind") != _OPEN)])
        least = written(known.withColumn("place", F.row_number().over(best)).where(col("place") == k).select("q", col("score").alias("least")))
        doubt = found.where(col("kind") == _OPEN).join(least, "q", "left").where(col("least").isNull() | (col("score") >= col("least")))
        doubt = written(doubt.select("q", "shard", F.coalesce("least", F.lit(1)).cast("bigint").alias("least")))
        settled.append(found.where(col("kind") == _EXACT).join(doubt.select("q", "shard"), ["q", "shard"], "left_anti").select(*found.columns))
        if doubt.isEmpty():
            break
        pairs = doubt.join(wanted, "q").groupBy("shard", number("q").alias("b")).agg(F.collect_list(F.struct("q", "terms", "least")).alias("items")).select("shard", "items")
    place = F.row_number().over(Window.partitionBy("q").orderBy(col("score").desc(), col("key").asc_nulls_last()))
    ranked = reduce(DataFrame.unionAll, settled).withColumn("rank", place).where(col("rank") <= k)
    out = ranked.join(asked.select("q", "item"), "q").select(col("item").alias(item), "rank", col("key").alias(key), "score")
    return out


def ranked(docs: DataFrame, items: DataFrame, item: str = "item_id", key: str = "doc_id", text: str = "text", k: int = 20, documents: int = DOCUMENTS, tiers: tuple[tuple[int, float], ...] = TIERS) -> DataFrame:
    """Index ``docs`` and search it for ``items``, whose texts are in a column of the same name."""
    counted = totals(docs, text)
    shards = stored(index(docs, counted, key, text, documents, tiers))
    return search(shards, items, counted, item, text, key, k)
