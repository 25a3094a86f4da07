"""Alignment of the tokens of two tokenizers, and the corpus-wide counts of aligned ids.

Tokenizer A is a byte-level BPE, B pieces with byte fallback that add a space before
the text. Over the bytes of a space and the text each byte gets a label: 0 where no
token ends, 1 where one of A ends, 2 where one of B ends, 3 where both do. A regular
expression scans the labels and extracts the spans up to each 3; the labels in a span
count the tokens of its group. Tokens of A and B in one group are linked.

A text with tokens that don't spell it has none.

1. One pass aligns runs of texts, in arrays over all their tokens, and writes blocks of
   documents of bounded size: each document's distinct linked pairs with how often it
   links each, and in how many documents of the block a pair is linked.
2. Spark sums these counts per pair over the blocks, and finds each A id's highest.
3. The counts return to the blocks that have the pair, by a join on the pair, and a
   block's documents take their sums from it.

A pair enters the shuffles once for each block that has it, however many documents
and links hold it there, so a pair that every document has is no hot key. Within a
group distinct ids are combined with how often each occurs, not all occurrences.

Edge cases: null and empty texts have no tokens, zeros and an empty digest; very long
texts are aligned whole, in stretches that end where tokens of neither tokenizer reach
across (before a space between other characters; that no piece of B holds such a space
is checked when its model is read); repeated rows are documents each; rows without an
id stay; an empty table gives an empty result; extra columns aren't carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from quilate.llm.bpe import _ODD, _PLAIN
from quilate.llm.common import discarded, tidied, written
from quilate.llm.pair_bpe import vocabulary_of

#: Distinct pairs of all documents in a block, documents in it, and characters aligned together.
BLOCK, DOCUMENTS, HELD = 1 << 20, 1 << 16, 1 << 19
#: Links of a group up to which all its occurrences are paired, instead of distinct ids with how often each occurs.
SMALL = 64
_SPAN = re.compile(rb"[^\x03]*\x03", re.DOTALL)
_SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Pieces:
    """Ids of texts by a model of pieces, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError(f"{path} has pieces that hold a space behind other characters")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        return self.model.encode(texts, num_threads=1)


def spans(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B tokens have ended by the end of each group, from where in ``size`` bytes tokens end."""
    labels = np.zeros(size, np.uint8)
    labels[ends_a - 1] |= 1
    labels[ends_b - 1] |= 2
    until = np.cumsum(np.fromiter(map(len, _SPAN.findall(labels.tobytes())), np.int64)) - 1
    return np.cumsum(labels & 1, dtype=np.int64)[until], np.cumsum(labels >> 1, dtype=np.int64)[until]


class Aligned:
    """What a text holds: counts, the text of its groups, and its distinct linked pairs with how often each is."""

    __slots__ = ("counts", "text", "pairs", "times")

    def __init__(self, counts: tuple[int, ...], text: str, pairs: np.ndarray, times: np.ndarray):
        self.counts, self.text, self.pairs, self.times = counts, text, pairs, times


class Aligner:
    """Aligns many texts at once, in arrays over all their tokens."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.path, self.pieces, vocabulary = path_a, Pieces(path_b), vocabulary_of(path_a)
        of = vocabulary.bytes_of
        self.bytes_a, self.bytes_b = np.array([of.get(i, b"") for i in range(max(of) + 1)], object), np.array(self.pieces.bytes_of, object)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # an id with what follows it in the text of groups
        self.written = np.array([f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)], object)
        self.width = np.array(list(map(len, self.written)), np.int64)
        # for texts of which both libraries see the same pre-tokens the other one is the faster
        plain = {x: i for i, x in of.items() if i not in vocabulary.added.values()}
        known = pattern == public_tokenizers.PATTERN
        self.quick = tiktoken.Encoding(path_a, pat_str=pattern, mergeable_ranks=plain, special_tokens={}).encode_ordinary if known else None

    @cached_property
    def library(self) -> Tokenizer:
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def first(self, text: str) -> list[int]:
        """Ids of A of a space and a text."""
        if self.quick and _PLAIN.match(text) and not _ODD.search(text):
            return self.quick(" " + text)
        return self.library.encode(" " + text, add_special_tokens=False).ids

    def make(self, own: list[str]) -> list[Aligned | None]:
        """Each text aligned, None where its tokens don't spell it."""
        first, second = [self.first(x) for x in own], self.pieces.encoded(own)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(own)) for x in (first, second))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (first, second))
        whole = [(" " + x).encode("utf-8", "replace") for x in own]
        size = np.fromiter(map(len, whole), np.int64, len(own))
        ends = [np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b)]
        spelt = np.ones(len(own), bool)
        for table, length, ids, end in ((self.bytes_a, self.length_a, ids_a, ends[0]), (self.bytes_b, self.length_b, ids_b, ends[1])):
            cut = np.concatenate([[0], np.cumsum(length[ids])])[end]
            spelt &= np.diff(cut) == size
            if not (spelt.all() and b"".join(table[ids].tolist()) == b"".join(whole)):
                spelt &= np.array([b"".join(table[ids[end[k] : end[k + 1]]].tolist()) == w for k, w in enumerate(whole)], bool)
        if not spelt.any():
            return [None] * len(own)
        found = self._aligned(n_a[spelt], n_b[spelt], ids_a[np.repeat(spelt, n_a)], ids_b[np.repeat(spelt, n_b)])
        return [next(found) if x else None for x in spelt.tolist()]

    def _aligned(self, n_a: np.ndarray, n_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> Iterator[Aligned]:
        """Texts of so many tokens of A and B each, all of which are spelt by both."""
        until_a, until_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        # of each group: tokens, where they begin, and the text
        last_a, last_b = spans(until_a, until_b, int(until_a[-1]))
        in_a, in_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        owner = np.searchsorted(np.cumsum(n_a), last_a)
        n_groups = np.bincount(owner, minlength=len(n_a))
        n_links = np.bincount(owner, in_a * in_b, len(n_a)).astype(np.int64)
        owners, pairs, times = self._pairs(ids_a, ids_b, last_a - in_a, last_b - in_b, in_a, in_b, owner)
        # the text: A tokens of a group, then its B tokens, the last ones marked
        both, of_a, of_b = len(ids_a) + len(ids_b), np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
        codes, ends_a, ends_b = np.empty(both, np.int64), np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        ends_a[last_a - 1], ends_b[last_b - 1] = 1, 1
        codes[np.arange(len(ids_a)) + (last_b - in_b)[of_a]] = ids_a + ends_a * len(self.bytes_a)
        codes[np.arange(len(ids_b)) + last_a[of_b]] = ids_b + ends_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        text = "".join(self.written[codes].tolist())
        cuts = np.concatenate([[0], np.cumsum(self.width[codes])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        rows = np.searchsorted(owners, np.arange(len(n_a) + 1)).tolist()
        for k, counts in enumerate(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True)):
            x, y = rows[k], rows[k + 1]
            yield Aligned(counts, text[cuts[k] : cuts[k + 1] - 1], pairs[x:y].copy(), times[x:y].copy())

    def _pairs(self, ids_a, ids_b, begin_a, begin_b, in_a, in_b, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, pair of ids) of linked tokens in order, and how often each is."""
        small = in_a * in_b <= SMALL
        n = np.where(small, in_a * in_b, 0)
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        keys = [ids_a[begin_a[of] + at // in_b[of]] << 32 | ids_b[begin_b[of] + at % in_b[of]]]
        owners, weights = [owner[of]], [np.ones(len(of), np.int64)]
        for g in np.flatnonzero(~small).tolist():  # distinct ids only
            (x, p), (y, q) = (np.unique(ids[k : k + m], return_counts=True) for ids, k, m in ((ids_a, begin_a[g], in_a[g]), (ids_b, begin_b[g], in_b[g])))
            keys.append((x[:, None] << 32 | y[None, :]).ravel())
            weights.append((p[:, None] * q[None, :]).ravel())
            owners.append(np.full(len(x) * len(y), owner[g]))
        key, text, weight = (np.concatenate(x) for x in (keys, owners, weights))
        order = np.lexsort((key, text))
        key, text, weight = key[order], text[order], weight[order]
        fresh = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
        return text[fresh], key[fresh], np.add.reduceat(weight, fresh)


@lru_cache(maxsize=2)
def aligner(path_a: str, pattern: str, path_b: str) -> Aligner:
    """Kept in a worker from task to task."""
    return Aligner(path_a, pattern, path_b)


def stretches(text: str, held: int) -> list[str]:
    """A text in stretches of about ``held`` characters, without the spaces between them."""
    out, at = [], 0
    while len(text) - at > held and (cut := _CUT.search(text, at + held)):
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def aligned(own: Aligner, texts: Iterable[str | None], held: int = HELD) -> Iterator[list[Aligned | None]]:
    """The aligned stretches of each text, about ``held`` characters aligned at a time; none for a null or empty one."""
    run: list[str] = []
    shape: list[int] = []
    done: list[Aligned | None] = []
    size = 0

    def ready() -> Iterator[list[Aligned | None]]:
        while shape and len(done) >= shape[0]:
            n = shape.pop(0)
            yield done[:n]
            del done[:n]

    for text in texts:
        parts = stretches(text, held) if text else []
        shape.append(len(parts))
        for part in parts:
            run.append(part)
            size += len(part)
            if size >= held:
                done += own.make(run)
                run, size = [], 0
        if not run:
            yield from ready()
    if run:
        done += own.make(run)
    yield from ready()


def _planes(x: np.ndarray) -> list[bytes]:
    """Numbers below 2 ** 32 in two halves, as the upper ones are mostly zero and pack well."""
    return [(x & 0xFFFF).astype("<u2").tobytes(), (x >> 16).astype("<u2").tobytes()]


def _numbers(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, "<u2").astype(np.int64) << 16


class _Block:
    """Documents of a block as they come."""

    def __init__(self):
        self.keys, self.counts, self.digests, self.pairs, self.times = [], [], [], [], []
        self.held = 0

    def add(self, key: object, own: list[Aligned | None]) -> None:
        self.keys.append(key)
        if None in own:
            own = []
        self.counts.append(tuple(map(sum, zip(*[x.counts for x in own], strict=True))) if own else (0, 0, 0, 0))
        digest = sha256()
        for k, x in enumerate(own):
            digest.update((";" * bool(k) + x.text).encode())
        self.digests.append(digest.hexdigest() if own else "")
        pairs, times = (own[0].pairs, own[0].times) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(own) > 1:
            pairs, at = np.unique(np.concatenate([x.pairs for x in own]), return_inverse=True)
            times = np.bincount(at, np.concatenate([x.times for x in own])).astype(np.int64)
        self.pairs.append(pairs)
        self.times.append(times)
        self.held += len(pairs)

    def row(self, block: int) -> dict[str, object]:
        lengths = np.array([len(x) for x in self.pairs], np.int64)
        pairs, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
        # a document has each of its pairs once
        held = np.bincount(place, minlength=len(pairs))
        packed = {k: v for name, x in (("pair", place), ("time", np.concatenate(self.times))) for k, v in zip((f"{name}_low", f"{name}_high"), _planes(x), strict=True)}
        shape = {"counts": np.array(self.counts, "<i8").tobytes(), "lengths": lengths.astype("<i8").tobytes()}
        return {"block": block, "keys": self.keys, "digests": self.digests, "pairs": pairs, "held": held} | shape | packed


_SHAPE = ("counts", "lengths", "pair_low", "pair_high", "time_low", "time_high")


def blocks(docs: DataFrame, path_a: str, pattern: str, path_b: str, key: str = "doc_id", text: str = "text", block: int = BLOCK, held: int = HELD) -> DataFrame:
    """Blocks of aligned documents, a row for each."""
    source = docs.select(f"`{key}`", f"`{text}`")
    kind = source.schema[key].dataType
    binary = ", ".join(f"{c} binary" for c in _SHAPE)
    schema = f"block bigint, keys array<{kind.simpleString()}>, digests array<string>, pairs array<bigint>, held array<bigint>, {binary}"
    types = {"block": pa.int64(), "keys": pa.list_(to_arrow_type(kind)), "digests": pa.list_(pa.string()), "pairs": pa.list_(pa.int64()), "held": pa.list_(pa.int64())} | dict.fromkeys(_SHAPE, pa.binary())

    def out(row: dict[str, object]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in types.items()], list(types))

    def run(batches):
        maker, number, own = aligner(path_a, pattern, path_b), TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, found in zip(keys, aligned(maker, (v.as_py() for v in batch.column(1)), held), strict=True):
                own.add(k, found)
                if own.held >= block or len(own.keys) >= DOCUMENTS:
                    yield out(own.row(number))
                    number, own = number + 1, _Block()
        if own.keys:
            yield out(own.row(number))

    return source.mapInArrow(run, schema)


@tidied
def alignments(docs: DataFrame, path_a: str, pattern: str, path_b: str, key: str = "doc_id", text: str = "text", block: int = BLOCK, held: int = HELD) -> DataFrame:
    """Per document its numbers of tokens, groups and links, the links of best count, the sum of counts and the groups' digest."""
    kind = docs.schema[key].dataType
    found = written(blocks(docs, path_a, pattern, path_b, key, text, block, held))
    linked = found.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("block", "place", col("x.pairs").alias("pair"), col("x.held").alias("held"))
    counts = written(linked.groupBy("pair").agg(F.sum("held").alias("n")))
    a = F.shiftright("pair", 32)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    judged = written(counts.join(best, a == col("a")).select("pair", "n", (col("n") == col("most")).alias("best")))
    discarded(counts)
    answers = linked.drop("held").join(judged, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("x"))
    answers = answers.select(col("block").alias("_b"), col("x.n").alias("n"), col("x.best").alias("best"))
    joined = found.join(answers, col("block") == col("_b"), "left").select("keys", "digests", "n", "best", *_SHAPE)
    schema = f"`{key}` {kind.simpleString()}, {', '.join(f'{c} bigint' for c in _COUNTS)}, n_best bigint, count_sum bigint, groups_sha256 string"
    names, arrow = [key, *_COUNTS, "n_best", "count_sum", "groups_sha256"], to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<i8"))])
                pair, times = (_numbers(row[f"{c}_low"], row[f"{c}_high"]) for c in ("pair", "time"))
                n, best = np.array(row["n"] or [], np.int64), np.array(row["best"] or [], bool)
                shape = np.frombuffer(row["counts"], "<i8").reshape(-1, 4)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (times * best[pair], times * n[pair])]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], arrow), *(pa.array(shape[:, i]) for i in range(4)), *map(pa.array, sums), pa.array(row["digests"], pa.string())], names)

    return joined.mapInArrow(run, schema)
