"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of fixed length that overlap. Each chunk is split into
pre-tokens on its own. A chunk that starts inside a pre-token splits wrongly at
first, but as soon as one of its boundaries coincides with a boundary of the
chunk before, both agree from there on: the pattern never looks back, so what
follows a boundary doesn't depend on what precedes it. Chunks are stitched at the
first common boundary; where the overlap holds none (a pre-token longer than the
overlap), the chunk is split again from the last sure boundary. The last
pre-token of a chunk is sure only if another follows it and a run of white space
doesn't reach the chunk's end, as the pattern looks ahead there. Where a pre-token
spans whole chunks, those inside it are passed over: each new attempt from the
last sure boundary is twice as long as the one before, so that the time stays in
proportion to the text. Chunks are short, so that most documents have several.

Each pre-token is encoded by the ranks; recent ones are remembered, within a
bound. Decoding looks the ids up and concatenates raw bytes, so every sequence
of ids decodes, and the bytes of an encoded text come back whole.

Edge cases: null is the empty text and has no ids; very long texts are encoded
whole; unpaired surrogates (which no UTF-8 input holds) are replaced as the
library does.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Pre-tokens remembered in a Python worker.
REMEMBERED = 300_000
CHUNK, OVERLAP = 1024, 96

#: Texts of these characters can be split by the faster library below: of the
#: ASCII, Latin-1 and Latin Extended-A letters, digits, punctuation and white space.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ſ–-…]*\\Z")
#: The same pattern for these characters: there a word character is a letter, a digit or the underscore.
_PLAIN_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Superscripts two and three are numbers, not decimal digits.
_ODD = re.compile("[\xb2\xb3]")


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding_of(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


class Splitter:
    """Pre-tokens of a text by overlapping chunks."""

    def __init__(self, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than a chunk")
        self.own, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap
        import public_tokenizers

        self.known = pattern == public_tokenizers.PATTERN

    def _finder(self, text: str):
        return _PLAIN_PATTERN if self.known and _PLAIN.match(text) and not _ODD.search(text) else self.own

    def split(self, text: str) -> list[str]:
        finder = self._finder(text)
        if len(text) <= self.chunk:
            return finder.findall(text)
        parts = [text[at : at + self.chunk] for at in range(0, len(text), self.chunk - self.overlap)]
        return self.stitch(text, [finder.findall(p) for p in parts], finder)

    def stitch(self, text: str, parts: list[list[str]], finder) -> list[str]:
        """Pre-tokens of ``text`` from those of its chunks, each split on its own."""
        step, done = self.chunk - self.overlap, []
        at = 0  # the last sure boundary
        wait = 0  # no use to split again from there before a chunk ends here
        for k, part in enumerate(parts):
            begin, last = k * step, k == len(parts) - 1
            end = min(begin + self.chunk, len(text))
            if at >= end or (end < wait and not last):
                continue
            place, i = begin, 0
            while place < at and i < len(part):
                place += len(part[i])
                i += 1
            if place != at:  # no common boundary: split from the sure one
                part, i, place = finder.findall(text[at:end]), 0, at
            stop = len(part)
            if not last:
                while stop > i and (stop == len(part) or part[stop][0].isspace()):
                    stop -= 1
                # what overlaps the next chunk is enough to meet it
                reach = end
                for j in range(len(part) - 1, stop - 1, -1):
                    reach -= len(part[j])
                target = begin + step
                while stop > i and reach - len(part[stop - 1]) >= target:
                    stop -= 1
                    reach -= len(part[stop])
            taken = part[i:stop]
            wait = 0 if taken else at + 2 * (end - at)
            done += taken
            at = place + sum(map(len, taken))
        if at < len(text):
            done += finder.findall(text[at:])
        return done


class _Memo(dict):
    """Results by pre-token, forgotten when there are too many."""

    def __init__(self, work: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.work, self.limit = work, limit

    def __missing__(self, piece: str):
        if len(self) >= self.limit:
            self.clear()
        self[piece] = out = self.work(piece)
        return out


class Codec:
    """Encoder and decoder for a rank file."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, remembered: int = REMEMBERED):
        self.splitter = Splitter(pattern, chunk, overlap)
        self.ranks = ranks_of(path)
        self.encoding = encoding_of(path, pattern)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.memo = _Memo(self.encode_piece, remembered)

    def encode_piece(self, piece: str) -> list[int]:
        known = self.ranks.get(piece.encode("utf-8", "replace"))
        # a pre-token on its own is one match of the pattern
        return [known] if known is not None else self.encoding.encode_ordinary(piece)

    def encode(self, text: str | None) -> list[int]:
        memo = self.memo
        return [i for piece in (self.splitter.split(text) if text else ()) for i in memo[piece]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _kept(df: DataFrame, own: set[str], keep: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in own or c == keep]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Replace column ``text`` by the ids of its tokens; other columns stay."""
    kept = [c for c in docs.columns if c not in (text, into)]
    source = docs.select(*[f"`{c}`" for c in kept], f"`{text}`")
    schema = StructType([*source.schema.fields[:-1], StructField(into, ArrayType(IntegerType(), False), False)])

    def run(batches):
        codec = Codec(path, pattern, chunk, overlap)
        for batch in batches:
            ids = pa.array([codec.encode(x) for x in batch.column(len(kept)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*kept, into])

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "bytes") -> DataFrame:
    """Replace column ``ids`` by the bytes that its tokens stand for; null has none."""
    kept = [c for c in tokens.columns if c not in (ids, into)]
    source = tokens.select(*[f"`{c}`" for c in kept], f"`{ids}`")
    schema = StructType([*source.schema.fields[:-1], StructField(into, BinaryType(), False)])

    def run(batches):
        codec = Codec(path, pattern)
        for batch in batches:
            raw = pa.array([codec.decode(x or ()) for x in batch.column(len(kept)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], [*kept, into])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document the number of its tokens, the SHA-256 of its ids and that of what they decode to.

    The same encoder and decoder in one pass, so that ids of the whole corpus
    never cross from Python to the JVM.
    """
    from hashlib import sha256

    source = docs.select(f"`{key}`", f"`{text}`")
    schema = f"`{key}` {source.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        codec = Codec(path, pattern, chunk, overlap)

        def both(piece: str) -> tuple[str, bytes]:
            ids = codec.encode_piece(piece)
            return ",".join(map(str, ids)), codec.decode(ids)

        memo = _Memo(both)
        get, split = memo.__getitem__, codec.splitter.split
        for batch in batches:
            counts, coded, decoded = [], [], []
            for x in batch.column(1):
                pairs = [get(piece) for piece in split(x.as_py() or "")]
                ids = ",".join([a for a, _ in pairs])
                counts.append(ids.count(",") + 1 if ids else 0)
                coded.append(sha256(ids.encode()).hexdigest())
                decoded.append(sha256(b"".join([b for _, b in pairs])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, schema)
