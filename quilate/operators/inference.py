"""Models applied to texts in batches: sentiment, sentence vectors, token counts.

A model is made once in a Python worker by a function that is passed in, and then takes
batches of texts; which library it comes from is the caller's choice. A batch that fails
gives its rows the unknown label, and the others aren't touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType

from quilate.functions.text import label_name
from quilate.operators.frames import require

#: A classifier takes texts and gives a mapping with ``label`` and ``score`` for each, or a list of such mappings (the highest score counts).
Classifier = Callable[[list[str]], Sequence]
#: An encoder takes texts and gives an array of (text, token, dimension); the first token stands for the text.
Encoder = Callable[[list[str]], np.ndarray]
#: Sizes of batches, and what a failed batch gives.
CLASSIFIED, ENCODED = 32, 16
UNKNOWN, UNKNOWN_SCORE = "UNKNOWN", 0.0


def _best(result) -> tuple[str, float]:
    found = max(result, key=lambda r: r["score"]) if isinstance(result, (list, tuple)) else result
    return str(found["label"]), float(found["score"])


def sentiment(df: DataFrame, text: str, make_model: Callable[[], Classifier], batch: int = CLASSIFIED) -> DataFrame:
    """Rows with a text, and their sentiment_label, sentiment_score and sentiment_normalized.

    Null and empty texts are left out, as there is nothing to judge.
    """
    require(df, text)

    def make():
        model = make_model()

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            own = [str(x) for x in texts]
            try:
                found = [_best(r) for r in model(own)]
                if len(found) != len(own):
                    raise ValueError("the model gave another number of results than texts")
            except Exception:  # whatever a model raises, its batch is unknown and the job goes on
                found = [(UNKNOWN, UNKNOWN_SCORE)] * len(own)
            return {"label": np.array([x for x, _ in found], object), "score": np.array([s for _, s in found], float)}

        return predict

    kind = StructType([StructField("label", StringType()), StructField("score", DoubleType())])
    judge = predict_batch_udf(make, return_type=kind, batch_size=batch)
    judged = df.where(F.length(text) > 0).withColumn("_judged", judge(col(text)))
    return judged.withColumns({"sentiment_label": col("_judged.label"), "sentiment_score": col("_judged.score"), "sentiment_normalized": label_name(col("_judged.label"))}).drop("_judged")


def sentiment_summary(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One frame: per normalized label its count and percentage, with the score's mean, deviation, least and greatest.

    Percentages are of all rows, or of all rows of a group of ``by``.
    """
    score = "sentiment_score"
    counts = judged.groupBy(*by, "sentiment_normalized").agg(
        F.count("*").alias("count"), F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"), F.min(score).alias("score_min"), F.max(score).alias("score_max")
    )
    names = [f"_by{i}" for i in range(len(by))]
    totals = counts.groupBy(*[col(b).alias(n) for b, n in zip(by, names, strict=True)]).agg(F.sum("count").alias("_every"))
    same = F.lit(True)
    for b, n in zip(by, names, strict=True):
        same &= col(b).eqNullSafe(col(n))
    return counts.join(totals, same).select(*by, "sentiment_normalized", "count", F.round(100.0 * col("count") / col("_every"), 2).alias("percentage"), "score_mean", "score_std", "score_min", "score_max")


def sentence_vectors(df: DataFrame, text: str, make_model: Callable[[], Encoder], into: str = "embedding", batch: int = ENCODED) -> DataFrame:
    """Add the vector of each text's first token; null is the empty text."""
    require(df, text)

    def make():
        model = make_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(model(["" if x is None else str(x) for x in texts])[:, 0, :], np.float32)

        return predict

    encode = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch)
    return df.withColumn(into, encode(F.coalesce(col(text), F.lit(""))))


def token_counts(df: DataFrame, text: str, path: str, into: str = "tokens") -> DataFrame:
    """Add the number of a model tokenizer's tokens of each text; null has none.

    ``path`` is a tokenizer file that all executors can read, as an install of the
    model's files or ``SparkContext.addFile`` gives them.
    """
    require(df, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != into)
    rows = df.drop(into)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        for pdf in batches:
            counts: list[int] = []
            texts = pdf[text].fillna("").tolist()
            for at in range(0, len(texts), 256):
                counts += [len(e.ids) for e in tokenizer.encode_batch(texts[at : at + 256], add_special_tokens=False)]
            yield pdf.assign(**{into: counts})

    return rows.mapInPandas(run, f"{fields}, `{into}` bigint")


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def prompt_cost(counted: DataFrame, by: Sequence[str], tokens: str = "tokens", per_million: float = 0.0) -> DataFrame:
    """Per group: prompts, their tokens, tokens per prompt, and the price at ``per_million`` tokens."""
    found = counted.groupBy(*by).agg(F.count("*").alias("prompts"), F.sum(tokens).alias("tokens"))
    return found.withColumns({"tokens_per_prompt": F.round(col("tokens") / col("prompts"), 4), "price": F.round(col("tokens") * F.lit(per_million) / 1e6, 6)})
