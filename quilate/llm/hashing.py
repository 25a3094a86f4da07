"""Vectorised hashes of words and word windows over batches of texts.

Words are maximal runs of bytes other than the six separators; texts are UTF-8,
whose longer characters never contain such a byte. Words are hashed by a
polynomial over 64-bit integers from prefix sums, windows of words by a
Rabin-Karp polynomial over the words' hashes in the same way; both are then
scrambled. All positions of a block of texts are handled at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilate.llm.common import mix64

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 18

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_LOWERED = _BYTES.copy()
_LOWERED[65:91] = _BYTES[97:123]
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", int(self.base)), ("down", _inverse(int(self.base)))):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))


def _spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial of values[begin:end] for each span."""
    powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.up[: len(values)], out=sums[1:])
    return (sums[end] - sums[begin]) * powers.down[begin]


def _words(data: np.ndarray, starts: np.ndarray, lower: bool, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of the words of ``data``; no word crosses a place in ``starts`` or an end."""
    gap = _GAP[data]
    fresh = np.empty(len(data) + 1, bool)
    fresh[0] = fresh[-1] = True
    fresh[1:-1] = gap[:-1]
    fresh[starts] = True  # a text's first byte follows no word of its own
    begin = np.flatnonzero(fresh[:-1] & ~gap)
    fresh[:-1] |= gap
    fresh[starts] = True
    end = np.flatnonzero(fresh[1:] & ~gap) + 1
    with np.errstate(over="ignore"):
        h = _spans((_LOWERED if lower else _BYTES)[data], begin, end, powers)
        return begin, end, mix64(h + (end - begin).astype(np.uint64) * _BASES[1])


def _cuts(data: np.ndarray) -> list[int]:
    """Places between words that part ``data`` into stretches of about ``BLOCK_BYTES``."""
    out, step = [0], 4096
    while out[-1] < len(data):
        at = out[-1] + BLOCK_BYTES
        while at < len(data):
            near = _GAP[data[at : at + step]]
            if near.any():
                at += int(near.argmax())
                break
            at += step
        out.append(min(at, len(data)))
    return out


class Block:
    """Words of a run of texts: ``words`` are hashes, text i has words first[i]:first[i + 1].

    A long text is hashed in stretches that end between words, so that its memory
    follows its words, not its bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, powers: list[_Powers]):
        self.data, self.offsets, self._powers = data, offsets, powers
        starts, found = offsets[:-1][offsets[:-1] < len(data)], []
        cuts = _cuts(data) if len(data) > 2 * BLOCK_BYTES else [0, len(data)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = starts[(starts >= a) & (starts < b)] - a
            begin, end, words = _words(data[a:b], own, lower, powers[0])
            found.append((begin + a, end + a, words))
        self.begin, self.end, self.words = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first = np.searchsorted(self.begin, offsets)

    def windows(self, size: int, salt: int = 0) -> np.ndarray:
        """Hash of the window that starts at each word; those of the last ``size - 1`` words of a text reach beyond it."""
        n = len(self.words)
        begin = np.arange(max(0, n - size + 1))
        with np.errstate(over="ignore"):
            h = _spans(self.words ^ mix64(np.array([salt], np.uint64))[0] if salt else self.words, begin, begin + size, self._powers[1 + bool(salt)])
            return mix64(h + np.uint64(size))

    def word_bytes(self, text: int, keep: np.ndarray) -> bytes:
        """The kept words of a text, joined by a space."""
        words = self.data[self.offsets[text] : self.offsets[text + 1]].tobytes().split()
        return b" ".join(words if keep.all() else compress(words, keep.tolist()))


class Blocks:
    """Cuts Arrow columns of texts into blocks; nulls are empty texts."""

    def __init__(self, lower: bool):
        self.lower, self.powers = lower, [_Powers(b) for b in _BASES]

    def of(self, column: pa.Array) -> Iterator[tuple[slice, Block]]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
            yield slice(i, j), Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.lower, self.powers)
            i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Bits of a filter, as a power of two, and bits of a piece of it.
FILTER, PIECE = 27, 1 << 15


def scrambled(v: np.ndarray) -> np.ndarray:
    """Hashes as a filter takes them: those chosen for being small are spread evenly again."""
    return mix64(v ^ _BASES[2])


def merged_bits(hashes: DataFrame, bits: int = FILTER) -> np.ndarray:
    """A Bloom filter of fixed size over a column ``v`` of scrambled hashes, as bytes on the driver.

    Partial bitmaps are filled before the shuffle and merged after it, by built-in
    aggregates, so that the driver only ever collects ``2 ** bits / 8`` bytes,
    whatever the number of hashes. A fuller filter lets more strangers pass but
    never drops a member.
    """
    mask = F.lit((1 << bits) - 1)
    places = hashes.select(F.explode(F.array(F.col("v").bitwiseAND(mask), F.shiftrightunsigned("v", 32).bitwiseAND(mask))).alias("p"))
    pieces = places.groupBy(F.shiftright("p", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(PIECE - 1))).alias("part"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in pieces.collect():
        at = row.piece * PIECE // 8
        out[at : at + PIECE // 8] = np.frombuffer(row.part, np.uint8)
    return out


def in_bits(v: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which scrambled hashes may be members."""
    mask, on = np.uint64(len(filled) * 8 - 1), np.ones(len(v), bool)
    for p in (v & mask, (v >> np.uint64(32)) & mask):
        p = p.astype(np.int64)
        on &= (filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return on
