"""Factorial prompt design: personas, rendered prompts, messages with stable ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quilate.functions.text import collapse_spaces, uuid5_dns

#: The trait lists of the design and what follows from a gender.
TRAITS = {
    "genero": ("homem", "mulher", "não-binária"),
    "raca": ("branca", "preta", "parda", "amarela", "indígena"),
    "regiao": ("nortista", "nordestina", "sudestina", "sulista", "centro-oestina"),
    "localidade": ("",),
    "unused": ("",),
}
ARTICLES = {"homem": "o", "mulher": "a", "não-binária": "a"}
PRONOUNS = {"homem": "ele", "mulher": "ela", "não-binária": "elu"}


def _looked_up(table: dict[str, str], x: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), x), F.lit(""))


def personas(spark: SparkSession, traits: dict[str, tuple[str, ...]] = TRAITS) -> DataFrame:
    """Every combination of trait values (the lists are the design, a few values each)."""
    return with_personas(spark.range(1).select(), traits)


def with_personas(df: DataFrame, traits: dict[str, tuple[str, ...]] = TRAITS) -> DataFrame:
    """Each row with every combination of trait values, an article and a pronoun; no join, as the lists are the design."""
    out = df
    for name, values in traits.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out.withColumns({"artigo": _looked_up(ARTICLES, F.col("genero")), "pronome": _looked_up(PRONOUNS, F.col("genero"))})


def rendered(template: Column, names: list[str]) -> Column:
    """The template with ``{{name}}`` replaced by columns, its white space collapsed."""
    return collapse_spaces(reduce(lambda t, n: F.replace(t, F.lit("{{" + n + "}}"), F.col(n)), names, template))


def messages(personas_: DataFrame, templates: DataFrame, models: list[str]) -> DataFrame:
    """All prompts of the design with their ids: personas x templates x models (their product is the design, a few thousand rows)."""
    return _messages(personas_.crossJoin(templates), models)


def designed(templates: DataFrame, models: list[str], traits: dict[str, tuple[str, ...]] = TRAITS) -> DataFrame:
    """As ``messages``, for templates of any number: each meets all personas and models where it lies, without a join."""
    return _messages(with_personas(templates, traits), models)


def _messages(grid: DataFrame, models: list[str]) -> DataFrame:
    names = [*TRAITS, "artigo", "pronome"]
    known = [n for n in names if n in grid.columns]
    text = grid.select("*", F.explode(F.array(*map(F.lit, models))).alias("model"))
    text = text.withColumn("message", rendered(F.col("original_prompt"), known))
    return text.withColumn("messageId", uuid5_dns(F.concat_ws("|", "original_prompt", *known, "model")))
