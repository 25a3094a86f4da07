"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets a few metrics. Fixed cutoffs are few (the base rule); all
others are fences from the quantiles of the metric among documents of the same
language and source. The quantiles come from mergeable sketches (KLL), one per
language, source and metric, built with partial sketches before the shuffle.
Quantiles of small groups say little, so each group's are blended with those of its
language in the proportion of its size to ``BLEND`` documents, and a language's in
the same way with those of all documents: a group of n weighs n / (n + BLEND).
There is no size at which a rule changes. The table of fences is written, and
documents are filtered by a join with it.

The fence of a metric is its median plus a multiple of the spread between its
quartiles, and at least a margin that keeps degenerate groups from rejecting
ordinary documents.

Edge cases: null and empty texts have no words and fail the base rule; null
languages and sources form a group of their own; metrics of texts without words
are zero and take no part in the sketches; repeated rows count each; an empty
table gives an empty result; extra columns stay. Column names that begin with
``_q_`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilate.llm.common import WORD_GAP, written

_GAPS = " \t\n\x0b\f\r"
#: The symbols that the rules count, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

#: Per adaptive metric: spreads above the median, and the least distance from it.
#: ``mean_chars`` has a lower fence too.
FENCES = {"symbols_per_word": (4.0, 0.25), "dup_lines": (4.0, 0.5), "repeat_words": (4.0, 0.25), "mean_chars": (6.0, 3.0)}
#: Documents at which a group's own quantiles weigh half, and the sketches' size.
BLEND, SKETCH = 50, 4096


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_metrics(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the counts of the base rule and ``_q_lines`` (lines with a word).

    A window's hash and place share one integer, the place in as many low bits as
    the text's length needs, so that one sort brings equal windows together. Some bits
    of the hash don't fit in, so the places found are sorted again by whole hashes.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_q_lines")
    plain = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in own])
    lines = F.filter(F.split(x, "\n"), lambda line: F.length(_without(line, _GAPS)) > 0)
    hashed = plain.withColumns({
        "_q_hashes": F.transform(F.filter(F.split(x, WORD_GAP), lambda w: w != ""), lambda w: F.xxhash64(w)),
        "_q_all_lines": F.transform(lines, lambda line: F.struct(F.xxhash64(F.lit(1), line), F.xxhash64(F.lit(2), line))),
    })
    n = F.size("_q_hashes")
    # the place of a window needs this many bits, its hash keeps the others
    counted = hashed.withColumns({
        "_q_grams": F.when(n >= window, F.transform(F.sequence(F.lit(1), n - F.lit(window - 1)), lambda i: F.xxhash64(F.slice("_q_hashes", i, window)))).otherwise(F.array().cast("array<bigint>")),
        "_q_bits": F.length(F.bin(n.cast("bigint"))),
    })
    found = counted.withColumn("_q_repeats", F.size(F.array_distinct("_q_grams")) < F.size("_q_grams"))
    sorted_keys = F.expr("""
        CASE WHEN _q_repeats THEN sort_array(transform(_q_grams, (g, i) ->
            shiftleft(shiftrightunsigned(g, _q_bits + 1), _q_bits) + cast(i AS bigint))) END""")
    keyed = found.withColumn("_q_keys", sorted_keys)
    places = F.expr("""
        CASE WHEN _q_repeats THEN sort_array(transform(filter(sequence(1, size(_q_keys)), j ->
            (j > 1 AND shiftright(_q_keys[j - 1], _q_bits) = shiftright(_q_keys[j - 2], _q_bits))
            OR (j < size(_q_keys) AND shiftright(_q_keys[j - 1], _q_bits) = shiftright(_q_keys[j], _q_bits))),
            j -> _q_keys[j - 1] & (shiftleft(1L, _q_bits) - 1))) END""")
    whole = F.expr("CASE WHEN _q_repeats THEN sort_array(transform(_q_near, p -> struct(_q_grams[cast(p AS int)] AS g, p AS p))) END")
    equal = F.expr("""
        CASE WHEN _q_repeats THEN sort_array(transform(filter(sequence(0, size(_q_whole) - 1), j ->
            (j > 0 AND _q_whole[j].g = _q_whole[j - 1].g) OR (j < size(_q_whole) - 1 AND _q_whole[j].g = _q_whole[j + 1].g)),
            j -> _q_whole[j].p)) END""")
    placed = keyed.withColumn("_q_near", places).withColumn("_q_whole", whole).withColumn("_q_places", equal)
    covered = F.expr(f"""
        CASE WHEN _q_repeats THEN aggregate(_q_places, struct(-{window}L AS last, 0L AS n),
            (a, p) -> struct(p AS last, a.n + least({window}L, p - a.last) AS n), a -> a.n) ELSE 0L END""")
    return placed.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(_without(x, _GAPS)).cast("bigint"),
        "n_symbols": (F.length(x) - F.length(_without(x, SYMBOLS))).cast("bigint"),
        "n_dup_lines": (F.size("_q_all_lines") - F.size(F.array_distinct("_q_all_lines"))).cast("bigint"),
        "n_repeat_words": covered,
        "_q_lines": F.size("_q_all_lines").cast("bigint"),
    }).drop("_q_hashes", "_q_all_lines", "_q_grams", "_q_bits", "_q_repeats", "_q_keys", "_q_near", "_q_whole", "_q_places")


def _ratios() -> dict[str, Column]:
    words, lines = F.col("n_words").cast("double"), F.col("_q_lines").cast("double")
    over = lambda a, b: F.when(b > 0, F.col(a) / b).otherwise(F.lit(0.0))
    return {"symbols_per_word": over("n_symbols", words), "dup_lines": over("n_dup_lines", lines), "repeat_words": over("n_repeat_words", words), "mean_chars": over("word_chars", words)}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketches(metrics: DataFrame, lang: str = "lang", source: str = "source", size: int = SKETCH) -> DataFrame:
    """One row per language and source: the number of documents with words and a sketch per metric.

    Sketches of several corpora or days can be merged by ``kll_merge_agg_double``.
    """
    aggregates = [F.kll_sketch_agg_double(v, size).alias(k) for k, v in _ratios().items()]
    return metrics.where("n_words > 0").groupBy(F.col(lang).alias("_q_lang"), F.col(source).alias("_q_source")).agg(F.count("*").alias("_q_n"), *aggregates)


def fences(sketched: DataFrame, blend: int = BLEND, size: int = SKETCH, limits: dict[str, tuple[float, float]] = FENCES) -> DataFrame:
    """Lower and upper fence of each metric for each language and source."""
    wanted = [(m, q) for m in limits for q in (0.25, 0.5, 0.75)]
    quartiles = lambda prefix: [F.kll_sketch_get_quantile_double(m, F.lit(q)).alias(f"{prefix}{i}") for i, (m, q) in enumerate(wanted)]
    merged = [F.sum("_q_n").alias("_q_n"), *[F.kll_merge_agg_double(m, size).alias(m) for m in limits]]
    # the quartiles of the whole corpus are a few numbers
    common = sketched.agg(*merged).where("_q_n > 0").select(*quartiles("")).first() or [0.0] * len(wanted)
    by_lang = sketched.groupBy(F.col("_q_lang").alias("_q_l")).agg(*merged).select("_q_l", F.col("_q_n").alias("_q_nl"), *quartiles("_q_b"))
    own = sketched.select("_q_lang", "_q_source", "_q_n", *quartiles("_q_a")).join(by_lang, F.col("_q_lang").eqNullSafe(F.col("_q_l")))
    share = lambda n: F.col(n) / (F.col(n) + F.lit(blend))
    mixed = lambda w, a, b: w * a + (1 - w) * b
    at = [mixed(share("_q_n"), F.col(f"_q_a{i}"), mixed(share("_q_nl"), F.col(f"_q_b{i}"), F.lit(common[i]))) for i in range(len(wanted))]
    columns = []
    for k, (m, (spreads, margin)) in enumerate(limits.items()):
        low, middle, high = at[3 * k : 3 * k + 3]
        reach = F.greatest(F.lit(spreads) * (high - low), F.lit(margin))
        columns += [(middle - reach).alias(f"_q_low_{m}"), (middle + reach).alias(f"_q_high_{m}")]
    return own.select("_q_lang", "_q_source", *columns)


def judged(metrics: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", names: dict[str, tuple[float, float]] = FENCES) -> DataFrame:
    """Add base_failed and kept to documents with metrics, by a join with the fences."""
    verdict = F.lit(True)
    for m, v in _ratios().items():
        if m in names:
            verdict &= F.coalesce(v <= F.col(f"_q_high_{m}"), F.lit(True))
            if m == "mean_chars":
                verdict &= F.coalesce(v >= F.col(f"_q_low_{m}"), F.lit(True))
    joined = metrics.drop("base_failed", "kept").join(limits, F.col(lang).eqNullSafe(F.col("_q_lang")) & F.col(source).eqNullSafe(F.col("_q_source")), "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict}).drop(*limits.columns)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document all its columns but the text, with metrics and verdict."""
    metrics = written(with_metrics(docs, text).drop(text))
    return judged(metrics, written(fences(sketches(metrics, lang, source))), lang, source)


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns as they came, also those named like a metric."""
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    aside = {c: f"_q_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in own}
    # written with the texts: a filter on the verdict must not be pushed into the metrics, which would nest them
    metrics = written(with_metrics(docs.withColumnsRenamed(aside), text))
    limits = written(fences(sketches(metrics, lang, source)))
    kept = judged(metrics, limits, lang, source).where("kept").drop(*own)
    return kept.withColumnsRenamed({v: k for k, v in aside.items()}).select(*[f"`{c}`" for c in docs.columns])
