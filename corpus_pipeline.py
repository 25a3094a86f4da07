"""A corpus pipeline: each stage takes the documents that the stage before left.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``:

* quality rules: documents that the rules reject go; null and empty texts have no words
  and go with them;
* line dedup: lines that match an earlier line go, documents stay, emptied ones with
  an empty text; rows without an id stay as they are;
* n-gram Jaccard join: of each component of near duplicates the document of the
  smallest id stays; documents without words link with nothing and stay, as do rows
  without an id; repeated rows of the leading id all stay;
* substring dedup: word windows that start earlier go, documents stay; rows that share
  an id are one document;
* best-fit packing: a row per piece of a document with its sequence and place; null
  and empty texts are a lone separator, repeated rows are packed each.

``n_chars`` follows changed texts (a null text has none). Very long texts are worked
on whole, columns beyond those of ``documents`` stay until the last stage, and an empty
table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilate.llm import lines, ngram_join, packing, quality, substrings
from quilate.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(lines.deduplicated(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(substrings.deduplicated(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The packing's local search has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
