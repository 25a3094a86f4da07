"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's set holds the hashes of its distinct words. Two lines match when the
Jaccard similarity of their sets reaches a threshold; of matching lines the
later one (larger id, or further down in its document) is removed. Lines are
judged on the input, not on what is left.

1. Words are counted in buckets of their hash, over all lines. Bucket counts,
   then hashes, order the words of every line, rare ones first.
2. Lines of equal sets form a class, found by an aggregate with a partial count
   before its shuffle, so that a line that repeats millions of times is one row.
   A class falls if it matches any class that begins earlier, so one match is
   enough; in a class that stays all lines but the first are removed.
3. Classes that match share a word among the rarest ``n - ceil(t n) + 1`` of each
   (prefix filter). The entries (word, class) are written once, in buckets of the
   word, so that no later join on the word shuffles or sorts them, and in two shares
   one after the other, which halves the disk that they take. Sets so small
   that only equal ones reach the threshold (up to three words at 0.8) need none.
4. Candidates must fit in length, in position (what both sets have from their
   shared word on bounds the overlap) and in their bitmaps: a class's bitmap holds
   in each bit whether an odd number of its words fall on it; bits that differ
   bound the symmetric difference from below. All of that is part of the join's
   condition, so that pairs that fail it are never rows.
5. In long lists each class is first compared with the list's earliest class; where
   many fell, those left are compared with the next ones for a few rounds. That
   settles groups of near copies without all their pairs. Classes still open are
   then compared with all earlier ones of their words.
6. Candidates' lines are read again by their places, and their whole sets compared.

Words and sets are known by hashes: words by 56 bits, sets by two of 64 bits with
different salts.

Edge cases: every line with a word is judged, lines without words stay; a document
whose lines are all removed stays with an empty text; rows that share an id are one
document, and a line number removed for one is removed for all; rows without an id
stay as they are; extra columns stay, whatever their names; an empty table gives an
empty result. Ids are integers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from quilate.llm.common import WORD_GAP, Places, bucketed, discarded, settings, tidied, unused, written

THRESHOLD = (4, 5)
#: Buckets of the word counts; classes that make a list long, and rounds of comparison with early classes of long lists.
BUCKETS, LONG, ROUNDS = 1 << 16, 64, 3
#: Shares of the lists, worked on one after the other.
SHARES = 2
_GAPS = " \t\x0b\f\r"
#: Lets the optimiser filter joins of any size by a Bloom filter of the smaller side.
_BLOOM = {"spark__sql__optimizer__runtime__bloomFilter__enabled": "true", "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0"}
#: A join on word and class may use that both sides are dealt by the word.
_BY_WORD = {"spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with a word, by document and number."""
    every = docs.where(col(key).isNotNull()).select(col(key).alias("d"), F.posexplode(F.split(col(text), "\n")).alias("p", "line"))
    return every.withColumn("line", F.btrim("line", F.lit(_GAPS))).where("line <> ''")


def _rarity(docs: DataFrame, key: str, text: str) -> str:
    """The class of each bucket by its count, as an SQL array literal of fixed length."""
    words = docs.where(col(key).isNotNull()).select(F.explode(F.split(col(text), WORD_GAP)).alias("w"))
    rows = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).count().collect()
    classes = ["0"] * BUCKETS
    for b, n in rows:
        # three steps per doubling
        classes[b] = str(min(127, (n * n * n).bit_length()))
    return f"cast(split('{','.join(classes)}', ',') AS array<tinyint>)"


def _ordered(lines: DataFrame, rarity: str) -> DataFrame:
    """Add the sets ``s`` in the global order (class in the high bits), their size and signature."""
    own = lines.withColumn("k", F.array_distinct(F.transform(F.split("line", WORD_GAP), lambda w: F.xxhash64(w)))).drop("line")
    key = F.expr(f"sort_array(transform(k, h -> shiftleft(cast({rarity}[cast(h & {BUCKETS - 1} AS int)] AS bigint), 56) | shiftrightunsigned(h, 8)))")
    return own.withColumn("s", key).drop("k").withColumns({"n": F.size("s"), "s1": F.xxhash64(F.lit(1), "s"), "s2": F.xxhash64(F.lit(2), "s")})


def _bitmap() -> dict[str, Column]:
    """Parities of the words that fall on each bit: 64 bits for sets of up to 64 words, 128 up to 128, 256 beyond."""
    some = lambda q, mask: f"aggregate(s, 0L, (x, h) -> if(h & {mask} = {q << 6}, x ^ shiftleft(1L, cast(h & 63 AS int)), x))"
    every = "aggregate(s, 0L, (x, h) -> x ^ shiftleft(1L, cast(h & 63 AS int)))"
    by_size = lambda *w: F.expr(f"CASE WHEN n <= 64 THEN {w[0]} WHEN n <= 128 THEN {w[1]} ELSE {w[2]} END")
    return {"w0": by_size(every, some(0, 64), some(0, 192)), "w1": by_size("0L", some(1, 64), some(1, 192)), "w2": by_size("0L", "0L", some(2, 192)), "w3": by_size("0L", "0L", some(3, 192))}


def _unlike() -> Column:
    """Bits in which the bitmaps w and x differ, both folded to the size of the smaller."""
    differ = [col(f"w{q}").bitwiseXOR(col(f"x{q}")) for q in range(4)]
    even, odd = differ[0].bitwiseXOR(differ[2]), differ[1].bitwiseXOR(differ[3])
    smaller = F.least("n", "m")
    return F.when(smaller <= 64, F.bit_count(even.bitwiseXOR(odd))).when(smaller <= 128, F.bit_count(even) + F.bit_count(odd)).otherwise(sum((F.bit_count(x) for x in differ[1:]), F.bit_count(differ[0])))


@tidied
def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per document with removed lines: its id ``d`` and the sorted numbers ``gone`` of those lines."""
    spark, (a, b) = docs.sparkSession, threshold
    places, rarity = Places(docs, key), _rarity(docs, key, text)
    # a set of n words and one of n + 1 are as much alike as different sets can be
    apart = b * col("n") < a * (col("n") + 1)
    prefix = F.slice("s", F.lit(1), F.when(apart, 0).otherwise(col("n") - F.ceil(col("n") * a / b) + 1).cast("int"))
    lines = _ordered(_lines(docs, key, text), rarity).withColumns(_bitmap())
    full = written(lines.select(places.of("d", "p").alias("place"), "s1", "s2", "n", *_bitmap(), prefix.alias("head")))
    classes = written(full.groupBy("s1", "s2", "n", *_bitmap(), "head").agg(F.min("place").alias("place"), F.count("*").alias("many")))
    slim = written(full.select("place", "s1", "s2"))
    discarded(full)
    parts = {"place": "before", "n": "m", "i": "j"} | {f"w{q}": f"x{q}" for q in range(4)}
    fits = (
        (col("before") < col("place")) & (b * col("n") >= a * col("m")) & (b * col("m") >= a * col("n"))
        & ((a + b) * F.least(col("n") - col("i"), col("m") - col("j")) >= a * (col("n") + col("m")))
        & ((a + b) * _unlike() <= (b - a) * (col("n") + col("m")))
    )

    def sets_of(at: DataFrame) -> DataFrame:
        """The sets of the lines at these places, made again from the texts."""
        wanted = at.groupBy(places.document("place").alias("w")).agg(F.collect_set(places.number("place")).alias("ps"))
        texts = docs.select(col(key).alias("d"), F.split(col(text), "\n").alias("all")).join(wanted, col("d") == col("w"))
        own = texts.select("d", F.explode(F.transform("ps", lambda p: F.struct(p.alias("p"), F.get("all", p).alias("line")))).alias("x")).select("d", "x.*")
        return _ordered(own.withColumn("line", F.btrim("line", F.lit(_GAPS))).where("line <> ''"), rarity).select(places.of("d", "p").alias("place"), "s", "n", "s1", "s2")

    def falls(pairs: DataFrame) -> DataFrame:
        """Classes (place, s1, s2) that match the earlier class of a pair."""
        pairs = written(pairs.select("place", "before").distinct())
        with settings(spark, **_BLOOM):
            sets = written(sets_of(pairs.select("place").unionAll(pairs.select("before")).distinct()))
        before = sets.select(col("place").alias("before"), col("s").alias("t"), col("n").alias("m"))
        common = F.size(F.array_intersect("s", "t"))
        out = written(pairs.join(sets, "place").join(before, "before").where(b * common >= a * (col("n") + col("m") - common)).select("place", "s1", "s2").distinct())
        discarded(pairs)
        discarded(sets)
        return out

    # of rows that share an id, different lines may have one place: they are never taken as settled by it
    twins = docs.groupBy(col(key).alias("twin")).count().where("count > 1").select("twin")

    def settled(fallen: DataFrame, share: int) -> DataFrame:
        """Entries (v, place) of fallen classes in a share of the lists."""
        single = fallen.join(twins, places.document("place") == col("twin"), "left_anti").select("s1", "s2")
        with settings(spark, **_BLOOM):
            return written(classes.join(single, ["s1", "s2"]).select(F.explode("head").alias("v"), "place").where(F.pmod("v", F.lit(SHARES)) == share))

    fallen, rest = [], []
    for share in range(SHARES):
        # words, and with them the lists, are dealt with in shares, so that only one of them is on disk at a time
        heads = classes.select("place", "n", *_bitmap(), F.posexplode("head").alias("i", "v")).where(F.pmod("v", F.lit(SHARES)) == share)
        entries, done = bucketed(heads, "v"), None
        earliest = F.min(F.struct(*parts)).alias("c")
        with settings(spark, **_BY_WORD):
            # in each round a long list's centre is its next later class
            found = entries.groupBy("v").agg(earliest, F.count("*").alias("many")).where(f"many >= {LONG}")
            for turn in range(ROUNDS):
                centre = written(found.select("v", *[col(f"c.{x}").alias(y) for x, y in parts.items()]))
                asked = entries.join(centre, "v").where(fits)
                gone = falls(asked if done is None else asked.join(done.hint("shuffle_hash"), ["v", "place"], "left_anti"))
                now = settled(gone, share)
                fallen.append(gone)
                done = now if done is None else done.unionAll(now)
                # a further round pays only in lists in which many classes fell
                again = written(now.groupBy("v").count().where(f"count >= {LONG}").select("v"))
                if again.isEmpty():
                    break
                last = centre.join(again, "v").select("v", col("before").alias("at"))
                later = entries.join(last, "v").where("place > at").join(done.hint("shuffle_hash"), ["v", "place"], "left_anti")
                found = later.groupBy("v").agg(earliest)
            still = entries.join(done.hint("shuffle_hash"), ["v", "place"], "left_anti")
            both = still.join(entries.select("v", *[col(x).alias(y) for x, y in parts.items()]), "v").where(fits)
            rest.append(written(both.select("place", "before").distinct()))
        discarded(entries)
    fallen.append(falls(reduce(DataFrame.unionAll, rest)))

    # lines of classes of one line that match none before stay
    fell = reduce(DataFrame.unionAll, fallen).select("s1", "s2").distinct().withColumn("fell", F.lit(True))
    marked = written(classes.select("s1", "s2", col("place").alias("first"), "many").join(fell, ["s1", "s2"], "left").where(col("fell") | (col("many") > 1)))
    discarded(classes)
    with settings(spark, **_BLOOM):
        judged = slim.join(marked, ["s1", "s2"]).where(col("fell") | (col("place") > col("first")))
        return written(judged.groupBy(places.document("place").alias("d")).agg(F.array_sort(F.collect_set(places.number("place"))).alias("gone")))


def _joined(docs: DataFrame, key: str, text: str, threshold: tuple[int, int]) -> tuple[DataFrame, str, str]:
    """``docs`` with the numbers of removed lines and with all lines, in columns whose names it returns."""
    one, name, every = (unused(docs, x) for x in ("id", "gone", "lines"))
    gone = removed_lines(docs.select(key, text), key, text, threshold).withColumnsRenamed({"d": one, "gone": name})
    joined = docs.join(gone.hint("shuffle_hash"), col(key) == col(one), "left").drop(one)
    return joined.withColumn(every, F.split(F.coalesce(col(text), F.lit("")), "\n")), name, every


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, its texts without the removed lines."""
    split, gone, every = _joined(docs, key, text, threshold)
    return split.withColumn(text, F.when(col(gone).isNotNull(), _rest(every, gone)).otherwise(col(text))).select(*[f"`{c}`" for c in docs.columns])


def _rest(every: str, gone: str) -> Column:
    """The lines whose numbers aren't among the removed ones; sets, so that long texts stay cheap."""
    numbers = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), col(gone))
    return F.array_join(F.transform(numbers, lambda i: F.get(every, i)), "\n")


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per document the numbers of its lines and of those removed, which ones, and the SHA-256 of what stays."""
    split, gone, every = _joined(docs.select(key, text), key, text, threshold)
    removed = F.coalesce(gone, F.array().cast("array<int>"))
    rest = F.when(col(gone).isNotNull(), _rest(every, gone)).otherwise(F.coalesce(col(text), F.lit("")))
    return split.select(key, F.size(every).cast("bigint").alias("n_lines"), F.size(removed).cast("bigint").alias("n_removed"), F.array_join(removed, ",").alias("removed"), F.sha2(rest, 256).alias("kept_sha256"))
