"""Column checks and choices, and joins by place."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quilate.operators.stats import ranked


class MissingColumns(ValueError):
    """A frame lacks columns that an operator needs."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The frame, if it has all the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Columns that are absent, as constants."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def numeric(df: DataFrame, *keep: str) -> DataFrame:
    """The numeric columns, and those named."""
    return df.select(*[f.name for f in df.schema.fields if f.name in keep or isinstance(f.dataType, NumericType)])


def named_like(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that a regular expression finds."""
    return [c for c in df.columns if re.search(pattern, c)]


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def new_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of ``b`` that ``a`` lacks."""
    return [c for c in b.columns if c not in a.columns]


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with places from 0 in the given order, without a window over one task."""
    first, *rest = order
    places = ranked(df.select(*order), first, then=tuple(rest)).select(*order, (F.col("k") - 1).alias(name))
    return df.join(places, list(order), "left")


def aligned(a: DataFrame, b: DataFrame, by_a: tuple[str, ...], by_b: tuple[str, ...]) -> DataFrame:
    """Rows of both frames side by side, by their places in the given orders; unequal ends have nulls.

    Columns of ``b`` that ``a`` has too get the ending ``_b``. The orders must tell rows apart.
    """
    left = numbered(a, "_place", *by_a)
    right = numbered(b, "_place_b", *by_b).withColumnsRenamed({c: f"{c}_b" for c in common_columns(a, b)})
    return left.join(right, F.col("_place") == F.col("_place_b"), "full").drop("_place", "_place_b")
