"""BPE encoding and decoding by an index of pair occurrences.

Texts are cut into chunks that begin at a space after a character that isn't white
space; the pattern of byte-level BPE has a boundary there whatever stands around,
so chunks can be encoded on their own and equal ones once. What a task hasn't met
yet is encoded together, all new pre-tokens of a block of texts at a time:

1. The bytes of all pre-tokens stand in one array, with a stop between pre-tokens,
   and links to the next and the previous symbol that is left.
2. An index maps each pair of neighbours that the vocabulary can merge to all its
   positions. A pair is known by its rank.
3. The active ranks wait in a heap. The lowest one is taken, and all its positions,
   in ascending order, are merged; the pairs to the left and to the right of each
   merge enter the lists of their own ranks, and positions whose symbols have
   changed meanwhile are passed over.

A merge can only make pairs of higher ranks (the vocabulary is checked for that), so
every pre-token sees its merges in the order in which it would on its own. The time
follows the number of merges, also within a single very long pre-token.

Strings of the tokenizer's added tokens are cut out of a text first and become
their own ids, as the library does. Decoding looks each id's bytes up, concatenates
them and reads them as UTF-8, with a replacement character for what isn't.

Edge cases: null is the empty text and has no ids; very long texts are encoded
whole; repeated rows are encoded each; an empty table gives an empty result; unpaired
surrogates (which no UTF-8 input holds) are replaced. Extra columns stay; one named
like the result is replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quilate.llm.bpe import _ODD, _PLAIN, _PLAIN_PATTERN

#: Chunks remembered in a Python worker, characters of text in a block, and bytes that one index takes at a time.
REMEMBERED, BLOCK, INDEXED = 1_000_000, 1 << 22, 1 << 20
#: Positions from which a rank is applied to all of them at once by array operations.
MANY = 100
#: Where a chunk begins: a space behind something that no library takes for white space.
_CUT = re.compile(r"(?<=\S)(?= )")
_RUN = re.compile(r" \s|\s ")
_STOP, _GONE = -2, -1
#: Marks the first chunk of a text, which has no space of its own; no UTF-8 text holds it.
FIRST = "\ud800"


def chunks(text: str) -> list[str]:
    """Parts of a space and ``text``, each without the space that it begins with.

    No pre-token, and no piece that begins with a space, reaches from one to the next.
    """
    return [c[1:] for c in _CUT.split(" " + text)] if text[:1].isspace() or _RUN.search(text) else text.split(" ")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges of a byte-level tokenizer file: ids of bytes, ranks of pairs, ids of ranks and bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, step = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or step["type"] != "ByteLevel" or step["add_prefix_space"] or file["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        of = byte_of_char()
        ids = model["vocab"]
        self.bytes_of = {i: bytes(of[c] for c in token) for token, i in ids.items()}
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in of.items():
            self.byte_ids[b] = ids[c]
        self.made, self.parts, self.rank, last = [], [], {}, {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if max(last.get(a, -1), last.get(b, -1)) >= r or a + b in last:
                raise ValueError(f"{path} has merges out of order")
            last[a + b] = r
            self.parts.append((ids[a], ids[b]))
            self.made.append(ids[a + b])
            self.rank[ids[a], ids[b]] = r
        self.added = {}
        for token in file["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"{path} has an added token that takes its surroundings")
            self.added[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        # ranks of two single bytes, by both bytes
        self.first = np.full(1 << 16, -1, np.int32)
        raw = {int(i): b for b, i in enumerate(self.byte_ids)}
        for (a, b), r in self.rank.items():
            if a in raw and b in raw:
                self.first[raw[a] << 8 | raw[b]] = r
        pairs = np.array([a << 32 | b for a, b in self.parts], np.int64)
        self.order = np.argsort(pairs)
        self.pairs = np.append(pairs[self.order], -1)
        self.order = np.append(self.order, 0)

    def ranks_of(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """Ranks of pairs of symbols, -1 where there is none."""
        pair = np.where(np.minimum(a, b) < 0, -2, (np.int64(1) << 32) * a + b)
        at = np.searchsorted(self.pairs[:-1], pair)
        return np.where(self.pairs[at] == pair, self.order[at], -1)

    def encode_together(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by one index of the pairs of all of them."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        size = int(starts[-1])
        # arrays for single symbols, and views of them for many at once; a stop stands before the first piece and behind each
        symbol, after, before = (array("q", bytes(8 * (size + 2))) for _ in range(3))
        symbols, afters, befores = (np.frombuffer(x, np.int64) for x in (symbol, after, before))
        symbols[:] = _STOP
        at = np.arange(1, len(data) + 1) + np.repeat(np.arange(len(pieces)), lengths)
        symbols[at] = self.byte_ids[data]
        afters[:], befores[:] = np.arange(1, size + 3), np.arange(-1, size + 1)
        index: dict[int, list[int]] = {}
        heap: list[int] = []

        def enter(ranks: np.ndarray, positions: np.ndarray) -> None:
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], positions[order].tolist()
            fresh = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
            for r, x, y in zip(ranks[fresh].tolist(), fresh.tolist(), [*fresh[1:].tolist(), len(ranks)], strict=True):
                if r in index:
                    index[r] += places[x:y]
                else:
                    index[r] = places[x:y]
                    heappush(heap, r)

        if len(data) > 1:
            near = self.first[data[:-1].astype(np.int64) << 8 | data[1:]]
            near[at[1:] != at[:-1] + 1] = -1
            enter(near[near >= 0], at[:-1][near >= 0])
        rank, parts, made = self.rank.get, self.parts, self.made
        while heap:
            r = heappop(heap)
            (a, b), c, positions = parts[r], made[r], index.pop(r)
            if len(positions) >= MANY and a != b:
                p = np.unique(positions)
                q = afters[p]
                live = (symbols[p] == a) & (symbols[q] == b)
                p, q = p[live], q[live]
                symbols[p], symbols[q] = c, _GONE
                q = afters[q]
                afters[p], befores[q] = q, p
                left = befores[p]
                ranks = np.concatenate([self.ranks_of(c, symbols[q]), self.ranks_of(symbols[left], c)])
                enter(ranks[ranks >= 0], np.concatenate([p, left])[ranks >= 0])
                continue
            positions.sort()
            for p in positions:
                q = after[p]
                if symbol[p] != a or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = c, _GONE
                after[p] = q = after[q]
                before[q] = p
                new = rank((c, symbol[q]))
                if new is not None:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heappush(heap, new)
                q = before[p]
                new = rank((symbol[q], c))
                if new is not None:
                    if new in index:
                        index[new].append(q)
                    else:
                        index[new] = [q]
                        heappush(heap, new)
        left = symbols >= 0
        ends = np.concatenate([[0], np.cumsum(left)])[starts + 1].tolist()
        ids = symbols[left].astype("<u4")
        return [ids[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids (little-endian unsigned 32-bit numbers) of chunks, those of a block of texts together."""

    def __init__(self, path: str, pattern: str, indexed: int = INDEXED):
        import public_tokenizers

        self.vocabulary, self.own = vocabulary_of(path), regex.compile(pattern)
        self.known, self.indexed = pattern == public_tokenizers.PATTERN, indexed

    def pre_tokens(self, chunk: str) -> list[str]:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if self.known and word.isalpha() and max(word) <= "\u017f":
            return [chunk]
        plain = self.known and _PLAIN.match(chunk) and not _ODD.search(chunk)
        return (_PLAIN_PATTERN if plain else self.own).findall(chunk)

    def encoded(self, new: Iterable[str]) -> dict[str, bytes]:
        """The ids of each of these chunks."""
        split = {c: self.pre_tokens(c[1:] if c[:1] == FIRST else " " + c) for c in new}
        pieces, run, held = {}, [], 0
        for p in {p for own in split.values() for p in own}:
            run.append(p)
            held += len(p)
            if held >= self.indexed:
                self._index(run, pieces)
                run, held = [], 0
        self._index(run, pieces)
        return {c: pieces[own[0]] if len(own) == 1 else b"".join([pieces[p] for p in own]) for c, own in split.items()}

    def _index(self, run: list[str], pieces: dict[str, bytes]) -> None:
        ids = self.vocabulary.encode_together([p.encode("utf-8", "replace") for p in run])
        pieces.update(zip(run, (x.tobytes() for x in ids), strict=True))

    def raw(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Texts:
    """What ``make`` gives for the chunks of texts, in order; results are remembered within a bound.

    ``added`` maps strings that are cut out of the texts to their results.
    """

    def __init__(self, make: Callable[[Iterable[str]], dict[str, object]], added: dict[str, object], remembered: int = REMEMBERED):
        self.make, self.added, self.remembered = make, {FIRST + s: x for s, x in added.items()}, remembered
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.memo: dict[str, object] = {}
        self.last: set[str] = set()

    def parts(self, text: str) -> list[str]:
        if self.cut and self.cut.search(text):
            return [c for part in self.cut.split(text) if part for c in ([FIRST + part] if FIRST + part in self.added else self.own(part))]
        return self.own(text)

    def own(self, text: str) -> list[str]:
        out = chunks(text)
        out[0] = FIRST + out[0]
        return out

    def of(self, texts: Iterable[str | None], block: int = BLOCK) -> Iterator[list[object]]:
        run, held = [], 0
        for text in texts:
            run.append(self.parts(text) if text else [])
            held += len(text or "")
            if held >= block:
                yield from self._block(run)
                run, held = [], 0
        yield from self._block(run)

    def _block(self, run: list[list[str]]) -> Iterator[list[object]]:
        every = set().union(*run)
        new = every.difference(self.memo)
        if len(self.memo) + len(new) > self.remembered:  # what the block before had is most likely to come again
            self.memo = {c: self.memo[c] for c in self.last}
            new = every.difference(self.memo)
        self.last = every
        self.memo.update({c: x for c, x in self.added.items() if c in new})
        self.memo.update(self.make(new.difference(self.added)))
        of = self.memo.__getitem__
        for own in run:
            yield list(map(of, own))


@lru_cache(maxsize=2)
def _both_ways(path: str, pattern: str) -> Texts:
    """Ids and decoded bytes of chunks; kept in a worker from task to task."""
    encoder = Encoder(path, pattern)

    def both(new: Iterable[str]) -> dict[str, tuple[bytes, bytes]]:
        return {c: (ids, encoder.raw(ids)) for c, ids in encoder.encoded(new).items()}

    return Texts(both, {s: (x := np.array([i], "<u4").tobytes(), encoder.raw(x)) for s, i in encoder.vocabulary.added.items()})


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Replace column ``text`` by the ids of its tokens; other columns stay."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), into.lower())]
    source = docs.select(*[f"`{c}`" for c in kept], f"`{text}`")
    schema = StructType([*source.schema.fields[:-1], StructField(into, ArrayType(IntegerType(), False), False)])

    def run(batches):
        texts = _both_ways(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(b"".join([a for a, _ in x]), "<i4") for x in texts.of(v.as_py() for v in batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*kept, into])

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Replace column ``ids`` by the text that its tokens stand for; null has none."""
    kept = [c for c in tokens.columns if c.lower() not in (ids.lower(), into.lower())]
    source = tokens.select(*[f"`{c}`" for c in kept], f"`{ids}`")
    schema = StructType([*source.schema.fields[:-1], StructField(into, StringType(), False)])

    def run(batches):
        of = vocabulary_of(path).bytes_of
        for batch in batches:
            found = [b"".join(of[i] for i in x.as_py() or ()).decode("utf-8", "replace") for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*kept, into])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of its tokens, the SHA-256 of its ids and that of the text they decode to.

    The same encoder and decoder in one pass, so that ids of the whole corpus
    never cross from Python to the JVM.
    """
    source = docs.select(f"`{key}`", f"`{text}`")
    schema = f"`{key}` {source.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        texts = _both_ways(path, pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for pairs in texts.of(v.as_py() for v in batch.column(1)):
                ids = b"".join([a for a, _ in pairs])
                counts.append(len(ids) // 4)
                coded.append(sha256(ids).hexdigest())
                decoded.append(sha256(b"".join([b for _, b in pairs]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, schema)
