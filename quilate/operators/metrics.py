"""All text metrics of a document in one pass: complexity and lemmas from its parse, stylometrics from its text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilate.functions import text as T
from quilate.operators import conllu
from quilate.operators.batches import measured

#: The metrics and what they are where a text is blank or can't be analysed.
DEFAULTS = {
    "MLC": 0.0, "MLS": 0.0, "DCC": 0.0, "CPC": 0.0, "profundidade_media": 0.0, "profundidade_max": 0, "ttr": 0.0, "lexical_density": 0.0, "token_quantity": 0,
    "noun_freq": 0.0, "verb_freq": 0.0, "adj_freq": 0.0, "adv_freq": 0.0, "avg_word_length": 0.0, "long_words_ratio": 0.0,
    "sentence_length_variance": 0.0, "punctuation_ratio": 0.0, "flesch_reading_ease": 0.0, "per_count": 0, "org_count": 0, "loc_count": 0, "lemmas": "",
}
#: Labels of an entity model by the count that they belong to.
ENTITIES = {"per_count": ("PER", "PERSON"), "org_count": ("ORG",), "loc_count": ("LOC", "GPE", "PLACE")}


def entity_counts(labels: Column) -> list[Column]:
    """Persons, organisations and places among the labels that an entity model gave."""
    return [F.coalesce(F.size(F.filter(labels, lambda x: x.isin(*wanted))), F.lit(0)).alias(name) for name, wanted in ENTITIES.items()]


def _syllables(words: pa.Array) -> np.ndarray:
    """``text.syllables`` of words in lower case."""
    letters = pc.replace_substring_regex(words, f"[^{T.PORTUGUESE_LETTERS}]", "")
    count = pc.count_substring_regex(letters, f"[{T.VOWELS}]+").to_numpy() - sum(pc.count_substring(letters, d).to_numpy() for d in T.DIPHTHONGS)
    return np.where(pc.equal(pc.utf8_trim(words, characters=" "), "").to_numpy(zero_copy_only=False), 0, np.maximum(1, count))


def word_counts(sentences: pa.Array) -> dict[str, np.ndarray]:
    """Per array of sentences (arrays of words in lower case): sentences, words, their squares by sentence, characters, syllables, long words.

    Each distinct word is measured once.
    """
    n, inner, document = len(sentences), sentences.flatten(), pc.list_parent_indices(sentences).to_numpy()
    coded, sentence = inner.flatten().dictionary_encode(), pc.list_parent_indices(inner).to_numpy()
    code, owner = coded.indices.to_numpy(zero_copy_only=False), document[sentence]
    length, held = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False), np.bincount(sentence, minlength=len(inner))
    total = lambda x: np.bincount(owner, x[code], n).astype(np.int64)
    return {
        "s": np.bincount(document, minlength=n), "k": np.bincount(owner, minlength=n), "k2": np.bincount(document, held * held, n).astype(np.int64),
        "chars": total(length), "syl": total(_syllables(coded.dictionary)), "long": total(length > 6),
    }


#: For ``batches.measured``.
WORDS = word_counts, dict.fromkeys(("s", "k", "k2", "chars", "syl", "long"), "bigint")


def _words(text: Column) -> Column:
    return F.transform(T.sentences(text), T.tokens)


def style_columns() -> list[Column]:
    """Word, sentence, syllable and punctuation metrics from ``WORDS`` and the punctuation marks ``p``, rounded to two places."""
    over = lambda c, n: F.when(n > 0, F.round(c / n, 2)).otherwise(0.0)
    k = F.col("k")
    return [
        over(F.col("chars"), k).alias("avg_word_length"), over(100 * F.col("long"), k).alias("long_words_ratio"),
        F.when(F.col("s") > 1, F.round((F.col("s") * F.col("k2") - k * k) / (F.col("s") * F.col("s")), 2)).otherwise(0.0).alias("sentence_length_variance"), over(100 * F.col("p"), k + F.col("p")).alias("punctuation_ratio"),
        F.round(T.flesch(k, F.col("s"), F.col("syl")), 2).alias("flesch_reading_ease"),
    ]


def analyzed(df: DataFrame, key: str, text: str, parse: str | None = None, entities: str | None = None, include_ner: bool = True, include_lemmatization: bool = True) -> DataFrame:
    """Per row with a key its key and the 22 metrics, in one pass without a shuffle.

    ``parse`` names a column of CoNLL-U text, ``entities`` one of entity labels (both
    come from injected models; see ``connect``); without them, and for blank texts,
    the metrics that need them have their defaults.
    """
    x = F.coalesce(text, F.lit(""))
    counts = entity_counts(F.col(entities)) if entities and include_ner else []
    wanted = df.where(F.col(key).isNotNull()).select(key, (F.trim(x) == "").alias("_blank"), *counts, T.punctuation(x).alias("p"), _words(x).alias("_words"), *([F.col(parse).alias("_parse")] if parse else []))
    found = measured(wanted, {"_words": WORDS} | ({"_parse": conllu.MEASURE} if parse else {}))
    more = [*conllu.complexity_columns(), *conllu.pos_columns(), "lemmas"] if parse else []
    out = found.select(key, "_blank", *(ENTITIES if counts else []), *style_columns(), *more)
    value = lambda m, d: F.when(F.col("_blank") | (F.lit(m == "lemmas") & F.lit(not include_lemmatization)), F.lit(d)).otherwise(F.coalesce(m, F.lit(d))) if m in out.columns else F.lit(d)
    return out.select(key, *[value(m, d).alias(m) for m, d in DEFAULTS.items()])


def added(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """``df`` with the metrics; columns of their names are replaced."""
    names = {m.lower() for m in DEFAULTS}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in names]).join(analyzed(df, key, text, **options), key, "left")


def corpus_totals(metrics: DataFrame) -> DataFrame:
    """Sums of the entity counts and means of the part-of-speech shares over a corpus."""
    return metrics.agg(*[F.sum(c).alias(f"total_{c}") for c in ENTITIES], *[F.avg(c).alias(f"mean_{c}") for c in ("noun_freq", "verb_freq", "adj_freq", "adv_freq")])


def summary(before: DataFrame, after: DataFrame, failed: Column) -> DataFrame:
    """Rows, columns, new columns, and how many rows succeeded and failed."""
    new = [c for c in after.columns if c not in before.columns]
    return after.agg(F.count("*").alias("n_rows"), F.lit(len(after.columns)).alias("n_columns"), F.lit(len(new)).alias("new_columns"), F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))
