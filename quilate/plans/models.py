"""Queries that apply a model to every text in batches; stand-ins take the models' places."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quilate.operators import inference, standins
from quilate.plans.catalogue import query, r6
from quilate.sources.tables import spread, table

_JUDGED = """j AS (SELECT doc_id, source, 'LABEL_' || (length(text) % 3) AS label, (length(text) % 97 + 1) / 98.0::DOUBLE AS score FROM documents WHERE length(text) > 0),
k AS (SELECT *, CASE label WHEN 'LABEL_0' THEN 'negative' WHEN 'LABEL_1' THEN 'neutral' ELSE 'positive' END AS name FROM j)"""


def _judged(s, d):
    docs = spread(table(s, d, "documents")).select("doc_id", "source", "text")
    return inference.sentiment(docs, "text", standins.length_classifier)


@query(f"WITH {_JUDGED} SELECT doc_id, label AS sentiment_label, round(score, 6) AS sentiment_score, name AS sentiment_normalized FROM k")
def sentiment(s, d):
    return _judged(s, d).select("doc_id", "sentiment_label", r6(F.col("sentiment_score")).alias("sentiment_score"), "sentiment_normalized")


@query(f"WITH {_JUDGED} SELECT source, name AS sentiment_normalized, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY source), 2) AS percentage, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max FROM k GROUP BY 1, 2")
def sentiment_summary(s, d):
    found = inference.sentiment_summary(_judged(s, d), ["source"])
    return found.select("source", "sentiment_normalized", "count", "percentage", *[r6(F.col(f"score_{x}")).alias(f"score_{x}") for x in ("mean", "std", "min", "max")])


@query("SELECT doc_id, " + ", ".join(f"round(((length(text) - length(replace(text, '{v}', ''))) / greatest(length(text), 1)::DOUBLE)::FLOAT::DOUBLE, 5) AS {v}" for v in standins.VOWELS) + " FROM documents")
def sentence_vectors(s, d):
    docs = spread(table(s, d, "documents")).select("doc_id", "text")
    found = inference.sentence_vectors(docs, "text", standins.vowel_encoder)
    return found.select("doc_id", *[F.round(F.col("embedding")[i].cast("double"), 5).alias(v) for i, v in enumerate(standins.VOWELS)])


@query()
def prompt_cost(s, d):
    """Tokens of all turns by role, counted by a model's tokenizer."""
    turns = table(s, d, "conversations").select("role", "text")
    counted = inference.token_counts(turns, "text", public_tokenizers.path("byte_bpe_50k.json"))
    return inference.prompt_cost(counted, ["role"], per_million=0.15)
