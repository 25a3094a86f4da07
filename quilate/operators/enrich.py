"""Incremental enrichment by external models: pending work, connectors, dead letters.

A connector is any callable that takes a text and returns a text; it is injected,
so that tests and offline runs use a stub.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Connector = Callable[[str], str]


def pending(items: DataFrame, done: DataFrame, key: str, times: int = 1) -> DataFrame:
    """Items that still lack results, a row per missing result."""
    if times == 1:
        return items.join(done.select(key), key, "left_anti")
    counts = done.groupBy(key).agg(F.count("*").alias("_n"))
    left = items.join(counts, key, "left").withColumn("_left", F.lit(times) - F.coalesce("_n", F.lit(0)))
    return left.where("_left > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_left").cast("int")))).drop("_n", "_left", "_turn")


def call(items: DataFrame, key: str, text: str, connect: Callable[[], Connector], into: str = "response", attempts: int = 3, delay: float = 0.0, per_second: float | None = None) -> DataFrame:
    """Call an external model for each row, with retries and a rate limit per task.

    ``connect`` makes a connector in each task. Failures become rows with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = connect()
        for pdf in batches:
            results, errors = [], []
            for x in pdf[text]:
                result = error = None
                for attempt in range(attempts):
                    try:
                        result, error = ask(x), None
                        break
                    except Exception as e:  # an external model may fail in any way; the error is kept with the row
                        error = f"{type(e).__name__}: {e}"
                        if attempt + 1 < attempts:
                            time.sleep(delay)
                if per_second:
                    time.sleep(1 / per_second)
                results.append(result)
                errors.append(error)
            yield pdf.assign(**{into: results, "error": errors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInPandas(run, f"{fields}, `{into}` string, error string")


def dead_letters(called: DataFrame, key: str, text: str) -> DataFrame:
    """Failed rows: id, error and the first 100 characters of the text."""
    return called.where(F.col("error").isNotNull()).select(key, "error", F.substring(text, 1, 100).alias("message_preview"))


def merged(messages: DataFrame, responses: DataFrame, parses: DataFrame | None = None) -> DataFrame:
    """Messages with their responses and, where there are any, parses; missing strings become empty."""
    out = messages.join(responses, "messageId", "left")
    if parses is not None and "responseId" in out.columns:
        out = out.join(parses, "responseId", "left")
    return out.na.fill("")
