"""Class-level lexical statistics: class-based TF-IDF and log-odds with a prior."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilate.functions.text import fixed, latin_words, tokens
from quilate.sources.scratch import written

#: The comparisons (column, target, reference) of a full batch; a group against itself scores zero.
COMPARISONS = (
    ("raca", "preta", "branca"), ("raca", "parda", "branca"), ("raca", "branca", "branca"), ("raca", "amarela", "branca"), ("raca", "indígena", "branca"),
    ("genero", "homem", "homem"), ("genero", "mulher", "homem"), ("genero", "não-binária", "homem"),
    ("regiao", "nortista", "sudestina"), ("regiao", "nordestina", "sudestina"), ("regiao", "sulista", "sudestina"), ("regiao", "sudestina", "sudestina"), ("regiao", "centro-oestina", "sudestina"),
)


class EmptyVocabulary(ValueError):
    """No document, or no term, is left to compare."""


def term_counts(docs: DataFrame, by: str = "lang", text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of each term in each class; null classes are left out."""
    terms = docs.where(F.col(by).isNotNull() & (F.length(text) > 0)).select(by, F.explode(tokens(F.col(text))).alias("term"))
    if stop:
        terms = terms.where(~F.col("term").isin(*stop))
    return terms.groupBy(by, "term").agg(F.count("*").alias("n"))


def ctfidf(counts: DataFrame, by: str = "lang", required: bool = False) -> DataFrame:
    """Class-based TF-IDF with square-rooted term frequencies and BM25 weights.

    The counts are written once, and all totals are taken from them. The classes'
    totals are few; joins with them and with the terms' totals are left to the
    planner, which broadcasts by measured size. ``required`` raises when there is
    no term at all.
    """
    counts = written(counts, "counts")
    classes = counts.groupBy(by).agg(F.sum("n").alias("class_total"))
    mean = classes.agg((F.sum("class_total") / F.count("*")).cast("bigint")).first()[0] or 0
    if required and not mean:
        raise EmptyVocabulary("no terms in any class")
    totals = counts.groupBy("term").agg(F.sum("n").alias("f"))
    tf = F.sqrt(F.col("n") / F.col("class_total"))
    idf = F.log(1 + (F.lit(float(mean)) - F.col("f") + 0.5) / (F.col("f") + 0.5))
    return counts.join(classes, by).join(totals, "term").select(by, "term", "n", (tf * idf).alias("score"))


def top_terms(scores: DataFrame, k: int, by: str = "lang", digits: int | None = None) -> DataFrame:
    """The terms of the k highest scores of each class; scores equal in ``digits`` digits are ties, but aren't rounded."""
    score = F.col("score") if digits is None else F.round("score", digits)
    order = Window.partitionBy(by).orderBy(score.desc(), F.asc("term"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "rank", "term", "score")


def cell() -> Column:
    """A term and its score like ``word (0.1234)``."""
    return F.concat("term", F.lit(" ("), fixed(F.col("score"), 4), F.lit(")"))


def report_line() -> Column:
    """A term and its z-score like ``word: 2.34``."""
    return F.concat("term", F.lit(": "), fixed(F.col("z"), 2))


def wide(top: DataFrame, classes: list[str], by: str = "lang") -> DataFrame:
    """A row per rank, a column per class, cells like ``word (0.1234)``."""
    return top.select(by, "rank", cell().alias("cell")).groupBy("rank").pivot(by, classes).agg(F.first("cell"))


def group_counts(docs: DataFrame, by: str | list[str], text: str = "text", max_share: float = 0.95, max_terms: int = 10_000, groups: tuple[str, ...] | None = None, stop: tuple[str, ...] = (), required: bool = False) -> DataFrame:
    """Term counts by class over the retained vocabulary; a null class is a class like others.

    Terms in more than ``max_share`` of the documents go; of the others the
    ``max_terms`` most frequent stay, ties in order of the term. Texts are split
    once: the rows that count occurrences and those that count documents go through
    one aggregate. The vocabulary is bounded by ``max_terms``, hence the broadcast.
    """
    keys = [by] if isinstance(by, str) else by
    rows = docs.select(*keys, latin_words(F.col(text)).alias("w"))
    if stop:
        rows = rows.select(*keys, F.array_except("w", F.array(*map(F.lit, stop))).alias("_own"), "w").select(*keys, F.filter("w", lambda x: F.array_contains("_own", x)).alias("w"))
    rows = rows.where(F.size("w") > 0)
    if groups:
        rows = rows.where(F.col(keys[0]).isin(*groups))
    # an empty term among those that count documents counts all of them
    both = F.array(F.struct(F.lit(False).alias("once"), F.col("w").alias("w")), F.struct(F.lit(True).alias("once"), F.concat(F.array_distinct("w"), F.array(F.lit(""))).alias("w")))
    terms = rows.select(*keys, F.explode(both).alias("_x")).select(*keys, F.col("_x.once").alias("_once"), F.explode("_x.w").alias("term"))
    counted = written(terms.groupBy(*keys, "_once", "term").agg(F.count("*").alias("n")), "counts")
    total = counted.where("term = ''").agg(F.sum("n")).first()[0] or 0
    if required and not total:
        raise EmptyVocabulary("no document with words")
    of = lambda x: F.sum(F.when(x, F.col("n")))
    stats = counted.where("term <> ''").groupBy("term").agg(of(~F.col("_once")).alias("tf"), of(F.col("_once")).alias("df")).where(F.col("df") <= max_share * total)
    vocabulary = stats.orderBy(F.desc("tf"), F.asc("term")).limit(max_terms).select("term")
    return counted.where("NOT _once").drop("_once").join(F.broadcast(vocabulary), "term")


def _odds(a: Column, b: Column, p: Column, ta: Column, tb: Column, tp: Column) -> Column:
    """The z-score of a term from its counts in target, reference and prior, and their totals."""
    x, y = a + p, b + p
    odds = lambda k, total: F.log(k / F.nullif(total - k, F.lit(0.0)) + 1e-10)
    return (odds(x, ta + tp) - odds(y, tb + tp)) / F.sqrt(1 / (x + 1e-10) + 1 / (y + 1e-10))


def log_odds(counts: DataFrame, target: str, reference: str, by: str = "lang") -> DataFrame:
    """Log-odds z-score of each term for ``target`` against ``reference``; all other classes, null too, are the prior."""
    at = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0)).cast("double")
    is_t, is_r = F.col(by).eqNullSafe(target), F.col(by).eqNullSafe(reference)
    terms = counts.groupBy("term").agg(at(is_t).alias("a"), at(is_r).alias("b"), at(~is_t & ~is_r).alias("p"))
    totals = terms.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"t{x}") for x in "abp"])
    return terms.crossJoin(F.broadcast(totals)).withColumn("z", _odds(*map(F.col, ("a", "b", "p", "ta", "tb", "tp")))).select("term", "a", "b", "p", "z")


def log_odds_batch(counts: DataFrame, comparisons: tuple[tuple[str, str, str], ...] = COMPARISONS) -> DataFrame:
    """The scores of all comparisons (column, target, reference): one aggregate over the counts by all columns."""
    sums, cells = [], []
    for i, (column, target, reference) in enumerate(comparisons):
        is_t, is_r = F.col(column).eqNullSafe(target), F.col(column).eqNullSafe(reference)
        for name, which in (("a", is_t), ("b", is_r), ("p", ~is_t & ~is_r)):
            sums.append(F.sum(F.when(which, F.col("n")).otherwise(0)).cast("double").alias(f"{name}{i}"))
        cells.append(F.struct(F.lit(column).alias("trait"), F.lit(target).alias("target"), F.lit(reference).alias("reference"), *[F.col(f"{x}{i}").alias(x) for x in "abp"]))
    terms = counts.groupBy("term").agg(*sums).select("term", F.explode(F.array(*cells)).alias("x")).select("term", "x.*")
    names = ["trait", "target", "reference"]
    totals = terms.groupBy(*names).agg(*[F.sum(x).alias(f"t{x}") for x in "abp"])
    return terms.join(F.broadcast(totals), names).select(*names, "term", _odds(*map(F.col, ("a", "b", "p", "ta", "tb", "tp"))).alias("z"))


def all_stop_words(spark, languages: tuple[str, ...] = ("portuguese", "english", "spanish"), more: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The union of the stop-word lists that ship with Spark, and of those given."""
    from pyspark.ml.feature import StopWordsRemover

    lists = [StopWordsRemover.loadDefaultStopWords(x) for x in languages]
    return tuple(sorted(reduce(lambda a, b: a | set(b), lists, set(more))))
