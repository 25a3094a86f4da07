"""Substring deduplication by Rabin-Karp hashes of word windows.

Every window of ``size`` consecutive words that also starts earlier in the corpus
(in a document of smaller id, or earlier in its own) is removed; windows are
judged on the input, and overlapping ones merge into maximal intervals.

1. Windows of equal words have the same rarest-by-hash short n-gram inside
   (their minimiser). The minimisers of all windows, about an eighth of the
   positions, are counted over the corpus, with a partial count before the
   shuffle. Those found twice or more go into a Bloom filter of fixed size, the
   only thing that is broadcast. A window without a minimiser in it is unique.
2. All other windows are counted by two 64-bit Rabin-Karp hashes. What comes out
   is the first place of each window, one row per distinct window, however often
   it repeats: a hot passage is reduced before the shuffle.
3. The first places of a document come back to it. Its windows that passed the
   filter and don't start at a first place are removed.

No row holds more than a document's own places, nothing but the fixed filter is
collected, and a full filter only makes step 2 count more windows.

Edge cases: null and short texts have no window; rows that share an id are one
document, so that a repeated row removes nothing from its twin; an empty table
gives an empty result; columns other than key and text aren't carried by
``removals``, while ``deduplicated`` keeps all columns and replaces the text.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quilate.llm.common import Places, tidied, unused, written
from quilate.llm.hashing import Block, Blocks, in_bits, merged_bits, scrambled, signed

SIZE = 20


def _minimisers(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes of short n-grams, the least in each window, and which windows lie within one text.

    The span of n-grams in a window is a power of two.
    """
    span = 1 << max(0, (size * 4 // 5).bit_length() - 1)
    gram = size - span + 1
    grams = block.windows(gram)
    least, k = grams, 1
    while k < span and len(least):
        least = np.minimum(least[:-k], least[k:]) if len(least) > k else least[:0]
        k *= 2
    n, sizes = len(block.words), np.diff(block.first)
    inside = np.arange(n) + size <= np.repeat(block.first[1:], sizes) if n else np.zeros(0, bool)
    return grams, least, inside[: len(least)], gram


def _repeated(docs: DataFrame, text: str, size: int) -> DataFrame:
    """Minimisers that occur at two places or more."""

    def run(batches):
        blocks = Blocks(False)
        for batch in batches:
            for _, block in blocks.of(batch.column(0)):
                grams, least, inside, gram = _minimisers(block, size)
                if not len(least):
                    continue
                # an n-gram is the least of some window if the greatest of its windows' leasts is its own hash
                span = size - gram + 1
                most = np.concatenate([np.zeros(span - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(len(grams) - len(least), np.uint64)])
                k = 1
                while k < span:
                    most = np.maximum(most[:-k], most[k:])
                    k *= 2
                v, c = np.unique(grams[(most == grams) & (most > 0)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(scrambled(v))), pa.array(c.astype(np.int64))], ["v", "c"])

    return docs.select(f"`{text}`").mapInArrow(run, "v bigint, c bigint").groupBy("v").agg(F.sum("c").alias("c")).where("c > 1").select("v")


def first_places(docs: DataFrame, filled, key: str, text: str, size: int) -> DataFrame:
    """Per document the sorted starts of the windows that start nowhere earlier, among those in the filter."""
    places = Places(docs, key)

    def run(batches):
        blocks = Blocks(False)
        for batch in batches:
            ids = batch.column(0)
            for rows, block in blocks.of(batch.column(1)):
                _, least, inside, _ = _minimisers(block, size)
                at = np.flatnonzero(inside & in_bits(scrambled(least), filled.value)) if len(least) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(block.first) - 1), np.diff(block.first))[at]
                h1, h2 = block.windows(size)[at], block.windows(size, 1)[at]
                names = ids.take(pa.array(owner + rows.start, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array(signed(h2)), names, pa.array((at - block.first[owner]).astype(np.int32))], ["h1", "h2", "d", "p"])

    kind = docs.schema[key].dataType.simpleString()
    windows = docs.select(f"`{key}`", f"`{text}`").where(F.col(key).isNotNull()).mapInArrow(run, f"h1 bigint, h2 bigint, d {kind}, p int")
    firsts = windows.groupBy("h1", "h2").agg(F.min(places.of("d", "p")).alias("m")).select(places.document("m").alias("d"), places.number("m").alias("p"))
    return firsts.groupBy("d").agg(F.collect_list("p").alias("firsts"))


@tidied
def _with_firsts(docs: DataFrame, key: str, text: str, size: int):
    filled = docs.sparkSession.sparkContext.broadcast(merged_bits(_repeated(docs.where(F.col(key).isNotNull()), text, size)))
    one, name = unused(docs, "first_id"), unused(docs, "firsts")
    firsts = written(first_places(docs, filled, key, text, size)).withColumnsRenamed({"d": one, "firsts": name})
    return docs.join(firsts.hint("shuffle_hash"), F.col(key) == F.col(one), "left"), name, filled


def _kept(block: Block, size: int, firsts: list[np.ndarray | None], filled: np.ndarray) -> np.ndarray:
    """Which words stay."""
    _, least, inside, _ = _minimisers(block, size)
    n = len(block.words)
    gone = np.zeros(n + 1, np.int64)
    if len(least):
        bad = inside & in_bits(scrambled(least), filled)
        for i, own in enumerate(firsts):
            if own is not None:
                bad[own + block.first[i]] = False
            # a document without a first place keeps all flagged windows' marks: each starts earlier elsewhere
        at = np.flatnonzero(bad)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + size, -1)
    return np.cumsum(gone[:-1]) == 0


def _pass(docs: DataFrame, key: str, text: str, size: int, columns: list[str], schema, finish) -> DataFrame:
    joined, name, filled = _with_firsts(docs, key, text, size)
    kept = [c for c in columns if c != text]
    source = joined.select(*[f"`{c}`" for c in kept], f"`{text}`", name, F.col(key).isNull().alias(unused(joined, "none")))
    k = len(kept)

    def run(batches):
        blocks = Blocks(False)
        for batch in batches:
            lists, none = batch.column(k + 1), batch.column(k + 2).to_pylist()
            for rows, block in blocks.of(batch.column(k)):
                own = [np.array(x.values) if (x := lists[i]).is_valid else None for i in range(rows.start, rows.stop)]
                stay = _kept(block, size, own, filled.value)
                for i in range(rows.stop - rows.start):
                    if none[rows.start + i]:  # without an id a row has no place in the order
                        stay[block.first[i] : block.first[i + 1]] = True
                yield finish(batch, rows, block, stay, kept)

    return source.mapInArrow(run, schema)


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Per document the numbers of its words and removed words, and the SHA-256 of the kept ones."""
    docs = docs.select(f"`{key}`", f"`{text}`")

    def finish(batch, rows, block, stay, kept):
        n, gone, sums = [], [], []
        for i in range(rows.stop - rows.start):
            own = stay[block.first[i] : block.first[i + 1]]
            n.append(len(own))
            gone.append(len(own) - int(own.sum()))
            sums.append(sha256(block.word_bytes(i, own)).hexdigest())
        ids = batch.column(0).slice(rows.start, rows.stop - rows.start)
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], [key, "n_words", "n_removed", "kept_sha256"])

    return _pass(docs, key, text, size, [key], f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string", finish)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """All columns of ``docs``; a text that loses words becomes its kept stretches, others stay as they are.

    What is left of a text keeps its white space; each removed interval leaves a
    single line feed between its neighbours.
    """
    columns = docs.columns
    order = [c for c in columns if c != text]
    schema = StructType([docs.schema[c] for c in order] + [docs.schema[text]])

    def finish(batch, rows, block, stay, kept):
        texts = []
        for i in range(rows.stop - rows.start):
            a, b = block.first[i], block.first[i + 1]
            own = stay[a:b]
            if own.all():
                texts.append(batch.column(len(kept))[rows.start + i].as_py())
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            parts = [block.data[block.begin[a + s] : block.end[a + e - 1]].tobytes() for s, e in zip(edge[::2], edge[1::2], strict=True)]
            texts.append(b"\n".join(parts).decode("utf-8", "replace"))
        own = [batch.column(j).slice(rows.start, rows.stop - rows.start) for j in range(len(kept))]
        return pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], [*kept, text])

    return _pass(docs, key, text, size, columns, schema, finish).select(*[f"`{c}`" for c in columns])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Per document that loses words the maximal removal intervals (first word, word after the last)."""
    docs = docs.select(f"`{key}`", f"`{text}`")
    pair = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([docs.schema[key], StructField("intervals", ArrayType(pair))])

    def finish(batch, rows, block, stay, kept):
        at, found = [], []
        for i in range(rows.stop - rows.start):
            own = ~stay[block.first[i] : block.first[i + 1]]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).tolist()
                at.append(rows.start + i)
                found.append([{"begin": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))], [key, "intervals"])

    return _pass(docs, key, text, size, [key], schema, finish)
