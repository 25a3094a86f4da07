"""Best-fit packing with a swap-based local search.

Documents become sequences of token ids that end with a separator. Only those
longer than a sequence are cut; of their pieces only the first may be shorter
than a sequence. Pieces are dealt at random (by a hash of their key) into shards
of bounded size, and each shard is packed on its own, so that no task ever holds
more than a shard and the places lost at shard ends stay below one sequence in
thousands.

Within a shard pieces are placed by best fit, longest first. Then underfull bins
exchange pieces one for one, two for one, or move them, whenever this raises the
sum of squared fills; emptier bins lose to fuller ones until some are empty and
vanish. The search ends when a pass over all pairs of underfull bins finds nothing,
or when no packing of the shard could have fewer bins.

Edge cases: null and empty texts are a lone separator; repeated rows are packed
once each; an empty table gives an empty result; columns of the input other than
the key and the text aren't carried along.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilate.llm.bpe import _ODD, _PLAIN, _PLAIN_PATTERN, REMEMBERED, Codec, _Memo
from quilate.llm.common import written

CAPACITY = 2048
#: Pieces in a shard, on average.
SHARD = 16_384
#: White space next to a space: there a split at spaces would part a run.
_RUN = re.compile(r" \s|\s ")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Tokens:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers.

    ``path`` is a tokenizer file, ``ranks`` the same vocabulary as ranks. Texts of
    Latin characters take the ranks, with results by word remembered; all others,
    and those that hold a special token's text, go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str, pattern: str, special: tuple[str, ...] = ("<|endoftext|>",)):
        self.path, self.special = path, special
        self.codec = Codec(ranks, pattern)
        self.first = _Memo(self._ids, 50_000)
        self.spaced = _Memo(lambda word: self._ids(" " + word), 2 * REMEMBERED)
        # only texts that the faster pattern splits rightly get there
        self.find = _PLAIN_PATTERN.findall if self.codec.splitter.known else self.codec.splitter.own.findall

    def _ids(self, text: str) -> bytes:
        return np.array([i for piece in self.find(text) for i in self.codec.encode_piece(piece)], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.match(text) or _ODD.search(text) or any(s in text for s in self.special):
            return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _RUN.search(text):
            return self._ids(text)
        words = text.split(" ")
        return self.first[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` tokens."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def pieces(docs: DataFrame, path: str, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", separator: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: key, piece, start, length, ids_crc32."""
    source = docs.select(f"`{key}`", f"`{text}`")
    end = np.array([separator], "<u4").tobytes()
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches):
        tokens = Tokens(path, ranks, pattern)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, x in enumerate(batch.column(1)):
                ids = tokens.encode(x.as_py()) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names)

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room for exactly r more
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int, partners: int = 64) -> list[list[int]]:
    """Local search on the underfull bins; each change raises the sum of squared fills.

    First a bin is compared with the ``partners`` next fuller ones, pass after pass;
    when that finds nothing more, with all fuller ones. The search ends when a pass
    over all pairs finds nothing, or when there are as few bins as the total length
    needs. Bins that are full, or that hold one piece too long to share a bin with any
    other, can't change.
    """
    size = [int(x) for x in lengths]
    fill = [sum(size[i] for i in b) for b in bins]
    shortest = min(size, default=0)
    live = {b for b in range(len(bins)) if fill[b] < capacity and not (len(bins[b]) == 1 and fill[b] + shortest > capacity)}

    def swap(a: int, b: int) -> bool:
        """Make the fuller bin ``b`` fuller with pieces of ``a``, by the largest gain that fits."""
        room, best = capacity - fill[b], (0, (), ())
        mine = sorted(bins[a], key=size.__getitem__, reverse=True)
        for x in mine:
            if best[0] < size[x] <= room:
                best = (size[x], (x,), ())
                break
        for y in bins[b]:
            reach = room + size[y]
            for i, x in enumerate(mine):
                if size[x] <= reach:
                    if size[x] - size[y] > best[0]:
                        best = (size[x] - size[y], (x,), (y,))
                    left = reach - size[x]
                    for z in mine[i + 1 :]:
                        if size[z] <= left:
                            if size[x] + size[z] - size[y] > best[0]:
                                best = (size[x] + size[z] - size[y], (x, z), (y,))
                            break
                    if best[0] == room:
                        break
            if best[0] == room:
                break
        gain, out, back = best
        if not gain:
            return False
        bins[a] = [i for i in bins[a] if i not in out] + list(back)
        bins[b] = [i for i in bins[b] if i not in back] + list(out)
        fill[a] -= gain
        fill[b] += gain
        return True

    least, reach = -(-sum(size) // capacity), partners
    while sum(map(bool, bins)) > least:
        order, changed = sorted(live, key=fill.__getitem__), False
        for k, a in enumerate(order):
            for b in order[k + 1 : k + 1 + reach]:
                if not bins[a]:
                    break
                if fill[b] < capacity and fill[b] >= fill[a]:
                    changed |= swap(a, b)
        live = {b for b in live if bins[b] and fill[b] < capacity}
        if not changed and reach >= len(order):
            break
        reach = partners if changed else len(order)
    return [b for b in bins if b]


def pack(items: DataFrame, key: list[str], length: str = "length", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Add sequence_id and offset to items of at most ``capacity``.

    ``key`` identifies an item; it only decides its shard and the order within.
    """
    items = written(items)
    shards = max(1, -(-items.count() // shard))
    dealt = items.withColumn("_shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, kind="stable", ignore_index=True)
        lengths = group[length].to_numpy()
        base = int(group["_shard"].iloc[0]) << 32
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for b, own in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            sequence[own] = base + b
            offset[own] = [0, *accumulate(int(lengths[i]) for i in own[:-1])]
        return group.drop(columns="_shard").assign(sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return dealt.groupBy("_shard").applyInPandas(one, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", separator: int = 0, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Pack whole documents: a row per piece with its place."""
    return pack(pieces(docs, path, ranks, pattern, key, text, separator, capacity), [key, "piece"], "length", capacity, shard)
