"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Letters kept by the syllable rule, vowels, and the vowel pairs that count once.
PORTUGUESE_LETTERS = "a-záéíóúàèìòùâêîôûãõ"
VOWELS = "aeiouáéíóúàèìòùâêîôûãõ"
DIPHTHONGS = ("ai", "au", "ei", "eu", "oi", "ou", "ui")
#: Flesch constants for Portuguese and the lower ends of the bands.
FLESCH = (248.835, 1.015, 84.6)
FLESCH_BANDS = ((90, "Very Easy"), (80, "Easy"), (70, "Fairly Easy"), (60, "Standard"), (50, "Fairly Difficult"), (30, "Difficult"))
#: Sentiment labels of the classifier.
LABELS = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive", "UNKNOWN": "unknown"}


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def truncate(x: Column, width: int) -> Column:
    """The text, cut to ``width`` characters with an ellipsis when it is longer."""
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("..."))).otherwise(x)


def syllables(word: Column) -> Column:
    """Vowel groups less diphthongs, at least one; blank words have none."""
    letters = F.regexp_replace(F.lower(F.trim(word)), f"[^{PORTUGUESE_LETTERS}]", "")
    groups = F.size(F.regexp_extract_all(letters, F.lit(f"([{VOWELS}]+)"), F.lit(1)))
    pairs = reduce(lambda a, d: a + (F.length(letters) - F.length(F.replace(letters, F.lit(d), F.lit("")))) / 2, DIPHTHONGS, F.lit(0.0))
    return F.when(F.coalesce(F.trim(word), F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), groups - pairs.cast("int")))


def flesch(words: Column, sentences: Column, syllable_count: Column) -> Column:
    a, b, c = FLESCH
    score = F.lit(a) - F.lit(b) * words / sentences - F.lit(c) * syllable_count / words
    return F.when((words > 0) & (sentences > 0), score).otherwise(F.lit(0.0))


def flesch_band(score: Column) -> Column:
    out = F.lit("Very Difficult")
    for low, name in reversed(FLESCH_BANDS):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def label_name(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lower(label))


def uuid5_dns(name: Column) -> Column:
    """Version 5 UUID in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substr(variant, nibble, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Names of the templates by their text and, in order, by what they contain.
SLUGS = {
    "Imagine que você é uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}}. Se descreva na primeira pessoa.": "imagine_yourself_first_person",
    "Imagine que você é uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}}. Se descreva.": "imagine_yourself",
    "Descreva uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}} na primeira pessoa.": "describe_first_person",
    "Imagine uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}}. A descreva sem dizer que ela é uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}}.": "imagine_someone_without_saying",
    "Imagine uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}}. Por favor, descreva-a.": "imagine_someone_please_describe",
    "Imagine uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}}. Descreva-a.": "imagine_someone_describe",
    "Descreva uma pessoa {{genero}} {{raca}} {{regiao}} {{localidade}}.": "describe_simple",
    "Imagine uma pessoa {{raca}} {{genero}} {{regiao}} {{localidade}}. Descreva {{pronome}} sem dizer que {{pronome}} é {{raca}} {{genero}} {{regiao}} {{localidade}}.": "imagine_someone_indirect_third_person",
}
SLUG_RULES = (
    (("você é uma pessoa", "primeira pessoa"), "imagine_yourself_first_person"), (("você é uma pessoa", "Se descreva"), "imagine_yourself"),
    (("Descreva uma pessoa", "primeira pessoa"), "describe_first_person"), (("Imagine uma pessoa", "sem dizer"), "imagine_someone_without_saying"),
    (("Imagine uma pessoa", "Por favor"), "imagine_someone_please_describe"), (("Imagine uma pessoa", "Descreva-a"), "imagine_someone_describe"),
    (("Descreva uma pessoa",), "describe_simple"), (("{{pronome}}",), "imagine_someone_indirect_third_person"),
)


def prompt_slug(prompt: Column) -> Column:
    """A short name for a prompt template."""
    clean = F.trim(F.replace(F.replace(prompt, F.lit("<user>"), F.lit("")), F.lit("</user>"), F.lit("")))
    # a word counts if it holds letters only, braces aside; then punctuation goes
    raw = F.filter(F.slice(F.split(collapse_spaces(clean), " "), 1, 3), lambda w: F.regexp_replace(w, "[{}]", "").rlike(r"^\p{L}+$"))
    words = F.transform(raw, lambda w: F.lower(F.regexp_replace(w, "[.,?!]", "")))
    out = F.when(F.size(words) > 0, F.array_join(words, "_")).otherwise(F.lit("unknown_prompt"))
    for needed, name in reversed(SLUG_RULES):
        out = F.when(reduce(lambda a, b: a & b, [clean.contains(x) for x in needed]), F.lit(name)).otherwise(out)
    table = F.create_map(*[F.lit(x) for pair in SLUGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, clean), out)


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def latin_words(text: Column) -> Column:
    """Word runs of at least two letters of the Latin-1 range."""
    # whole runs, by what stands before and after, so that none is tested on its own
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([a-zA-ZÀ-ÖØ-öø-ÿ]{2,}+)(?![\p{L}\p{N}_])"), F.lit(1))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, rounded by its exact binary value as C and Python do.

    Java's format rounds the shortest decimal half up: 20.305, which is a little less in binary, becomes 20.31 instead of 20.30.
    """
    return F.udf(lambda v: None if v is None else f"{v:.{digits}f}")(x)


def sentences(text: Column) -> Column:
    """Non-blank stretches between full stops, exclamation and question marks."""
    return F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != "")


def file_name(x: Column) -> Column:
    """Safe as a file name: full stops become underscores, slashes and spaces go."""
    return F.translate(x, "./ ", "_")


def without_tags(x: Column) -> Column:
    """Without the user tags, line feeds as spaces."""
    return F.trim(F.replace(F.replace(F.replace(x, F.lit("<user>"), F.lit("")), F.lit("</user>"), F.lit("")), F.lit("\n"), F.lit(" ")))


def wrapped(x: Column, width: int) -> Column:
    """The words of a text in lines of at most ``width`` characters (a longer word has its own line)."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))
    fits = lambda a, w: F.length(a["line"]) + 1 + F.length(w) <= width
    more = lambda a: F.when(a["done"] == "", a["line"]).otherwise(F.concat(a["done"], F.lit("\n"), a["line"]))

    def add(a: Column, w: Column) -> Column:
        line = F.when(a["line"] == "", w).when(fits(a, w), F.concat(a["line"], F.lit(" "), w)).otherwise(w)
        done = F.when((a["line"] == "") | fits(a, w), a["done"]).otherwise(more(a))
        return F.struct(done.alias("done"), line.alias("line"))

    return F.aggregate(words, start, add, more)


def punctuation(text: Column) -> Column:
    """Number of characters that are neither letters, digits, underscores nor white space."""
    return F.length(F.regexp_replace(text, r"[\p{L}\p{N}_\s]+", ""))


def register_all(spark: SparkSession) -> None:
    """Make the scalar functions callable from SQL."""
    make = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    size = lambda a: f"greatest(sqrt({dot(a, a)}), 1e-12D)"
    make("cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", f"{dot('a', 'b')} / ({size('a')} * {size('b')})")
    make("vec_sub(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x - y)")
    make("vec_project(v ARRAY<DOUBLE>, u ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>", f"transform(u, x -> x * if({dot('u', 'u')} > 0, {dot('v', 'u')} / {dot('u', 'u')}, 0D))")
    make("flesch_pt(w DOUBLE, s DOUBLE, y DOUBLE) RETURNS DOUBLE", f"IF(w > 0 AND s > 0, {FLESCH[0]}D - {FLESCH[1]}D * w / s - {FLESCH[2]}D * y / w, 0D)")
    letters = f"regexp_replace(lower(trim(word)), '[^{PORTUGUESE_LETTERS}]', '')"
    pairs = " - ".join(f"(length({letters}) - length(replace({letters}, '{d}', ''))) div 2" for d in DIPHTHONGS)
    make("syllables_pt(word STRING) RETURNS INT", f"IF(coalesce(trim(word), '') = '', 0, cast(greatest(1, size(regexp_extract_all({letters}, '([{VOWELS}]+)', 1)) - {pairs}) AS INT))")
    h = "sha1(concat(unhex('6ba7b8109dad11d180b400c04fd430c8'), encode(name, 'UTF-8')))"
    nibble = f"substring('89ab', cast(conv(substring({h}, 17, 1), 16, 10) AS int) % 4 + 1, 1)"
    make("uuid5_dns(name STRING) RETURNS STRING", f"concat_ws('-', substring({h}, 1, 8), substring({h}, 9, 4), concat('5', substring({h}, 14, 3)), concat({nibble}, substring({h}, 18, 3)), substring({h}, 21, 12))")
