"""Dependency parses in CoNLL-U text: tokens in native expressions; lemmas, complexity and shares counted in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilate.operators.batches import measured, per_distinct

#: Parts of relation names that mark clauses, dependent clauses and coordination.
CLAUSE, DEPENDENT, COORDINATION = ("csubj", "ccomp", "xcomp", "advcl", "acl"), ("advcl", "acl"), ("conj", "cc")
POS = ("NOUN", "VERB", "ADJ", "ADV")
METRICS = ("MLC", "MLS", "DCC", "CPC", "profundidade_media", "profundidade_max", "ttr", "lexical_density", "token_quantity")
_NUMBER, _BLANKS = re.compile(r"[+-]?[0-9]+"), "".join(map(chr, range(33)))


def parsed(text: Column) -> Column:
    """Sentences, each an array of tokens; rows of multiword tokens stay among them."""
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: F.trim(b) != "")

    def sentence(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
        # each row is split once
        rows = F.transform(lines, lambda x: F.split(x, "\t"))
        fields = {"id": 0, "form": 1, "lemma": 2, "upos": 3, "head": 6, "deprel": 7}
        return F.transform(rows, lambda c: F.struct(*[F.get(c, i).alias(name) for name, i in fields.items()]))

    return F.transform(blocks, sentence)


def word_lists(text: Column) -> tuple[Column, Column]:
    """The forms of adjectives and of nouns of a parse."""
    tokens = F.flatten(parsed(F.coalesce(text, F.lit(""))))
    forms = lambda p: F.transform(F.filter(tokens, lambda t: t["upos"] == p), lambda t: t["form"])
    return forms("ADJ"), forms("NOUN")


def lemmas(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: ~t["deprel"].isin("punct", "nummod"))
    return F.array_join(F.transform(kept, lambda t: t["lemma"]), " ")


def generated(words: Column) -> Column:
    """A stand-in parse for an array of sentences (arrays of words), for tests and offline runs.

    Part of speech and relation follow from a word's length and place; each word hangs from the one at half its place.
    """
    upos = F.array(*map(F.lit, ("NOUN", "VERB", "ADJ", "ADV", "DET", "PUNCT")))
    deprel = F.array(*map(F.lit, ("nsubj", "obj", "ccomp", "xcomp", "advcl", "acl", "conj", "cc", "punct", "nummod", "advmod")))

    def row(w: Column, i: Column) -> Column:
        k = i + 1
        return F.concat_ws("\t", k.cast("string"), w, F.lower(w), F.get(upos, F.length(w) % 6), F.lit("_"), F.lit("_"), F.floor(k / 2).cast("string"), F.get(deprel, (F.length(w) + k) % 11), F.lit("_"), F.lit("_"))

    return F.array_join(F.transform(words, lambda s: F.array_join(F.transform(s, row), "\n")), "\n\n")


def _head(text: str) -> int:
    """A head as a whole number of 32 bits; anything else is the root's."""
    text = text.strip(_BLANKS)
    n = int(text) if _NUMBER.fullmatch(text) else 0
    return n if -(1 << 31) <= n < 1 << 31 else 0


def _depths(ids: pa.Array, heads: pa.Array, sentence: np.ndarray, count: int) -> np.ndarray:
    """Depth of each sentence's tree by pointer doubling: every token jumps to its ancestor twice as far up each time.

    ``at`` holds the ancestor reached (-1 above the root), ``d`` the edges to it; after log2(n) jumps all are at the root.
    """
    own = ~per_distinct(ids, lambda x: "-" in x or "." in x)[0]
    sentence = sentence[own]
    coded = heads.filter(pa.array(own)).dictionary_encode()
    values = np.array([*map(_head, coded.dictionary.to_pylist()), 0], np.int64)
    head = values[coded.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)]
    size = np.bincount(sentence, minlength=count)
    first, depth = np.cumsum(size) - size, np.zeros(count, np.int64)
    at = np.where((head >= 1) & (head <= size[sentence]), first[sentence] + head - 1, -1)
    d = (at >= 0).astype(np.int64)
    jumps = (np.ceil(np.log(size + 1.0) / np.log(2.0)).astype(np.int64) + 1)[sentence]
    for k in range(1, int(jumps.max(initial=0)) + 1):
        moving = np.flatnonzero((at >= 0) & (jumps >= k))
        if not len(moving):
            break
        to = at[moving]
        # only after all are read
        more, further = d[to], at[to]
        d[moving] += more
        at[moving] = further
    some = size > 0
    if some.any():
        depth[some] = np.maximum.reduceat(d, first[some])
    return depth


def counts(text: pa.Array) -> dict[str, object]:
    """``COUNTS`` of each parse of an array, and its lemmas; null is empty."""
    n = len(text)
    by_block = pc.split_pattern_regex(text.fill_null(""), r"\n[ \t\n\x0B\f\r]*\n")
    blocks, document = by_block.flatten(), pc.list_parent_indices(by_block).to_numpy()
    some = pc.not_equal(pc.utf8_trim(blocks, characters=" "), "")
    blocks, document = blocks.filter(some), document[some.to_numpy(zero_copy_only=False)]
    by_line = pc.split_pattern(blocks, "\n")
    lines, sentence = by_line.flatten(), pc.list_parent_indices(by_line).to_numpy()
    some = pc.and_not(pc.not_equal(pc.utf8_trim(lines, characters=" "), ""), pc.starts_with(lines, "#"))
    lines, sentence = lines.filter(some), sentence[some.to_numpy(zero_copy_only=False)].astype(np.int64)
    fields = pc.split_pattern(lines, "\t")
    starts, widths = fields.offsets.to_numpy()[:-1], np.diff(fields.offsets.to_numpy())
    ids, forms, lemma, upos, heads, deprel = (fields.values.take(pa.array(starts + i, mask=widths <= i)) for i in (0, 1, 2, 3, 6, 7))
    owner = document[sentence].astype(np.int64)
    within = lambda parts: lambda x: any(p in x for p in parts)
    plain, kept, clause, dependent, joined, advmod = per_distinct(deprel, lambda x: x != "punct", lambda x: x not in ("punct", "nummod"), within(CLAUSE), within(DEPENDENT), within(COORDINATION), within(("advmod",)))
    word, open_, content = per_distinct(upos, lambda x: x != "PUNCT", lambda x: x not in ("PUNCT", "SPACE", "_"), lambda x: x in ("NOUN", "ADJ", "VERB"))
    kinds = per_distinct(upos, *[lambda x, p=p: x == p for p in POS])
    total = lambda on: np.bincount(owner[on], minlength=n)
    coded = forms.dictionary_encode(null_encoding="encode")
    pairs, width = owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), max(1, len(coded.dictionary))
    types = lambda x: np.bincount(np.unique(x) // width, minlength=n)
    rows = np.bincount(sentence, minlength=len(blocks))
    depth, deepest = _depths(ids, heads, sentence, len(blocks)), np.zeros(n, np.int64)
    np.maximum.at(deepest, document, depth)
    ends = lambda at, m: pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=m))]), pa.int32())
    each = pc.binary_join(pa.ListArray.from_arrays(ends(sentence[kept], len(blocks)), lemma.filter(pa.array(kept))), " ")
    some = pc.not_equal(each, "")
    whole = pc.binary_join(pa.ListArray.from_arrays(ends(document[some.to_numpy(zero_copy_only=False)], n), each.filter(some)), " ")
    return {
        "rows": np.bincount(owner, minlength=n), "plain": total(plain), "words": total(word), "clauses": total(clause), "dependent": total(dependent), "coordinated": total(joined),
        "content": total(plain & content), "content_or_adverbial": total(content | advmod), "types": types(pairs[plain]), "all_types": types(pairs),
        "sentences": np.bincount(document[rows > 0], minlength=n), "blocks": np.bincount(document, minlength=n), "depths": np.bincount(document, depth, n).astype(np.int64), "deepest": deepest,
        "open": total(open_), **{p: total(on) for p, on in zip(POS, kinds, strict=True)}, "lemmas": whole,
    }


#: Columns that ``counts`` gives, with their types.
COUNTS = dict.fromkeys(("rows", "plain", "words", "clauses", "dependent", "coordinated", "content", "content_or_adverbial", "types", "all_types", "sentences", "blocks", "depths", "deepest", "open", *POS), "bigint") | {"lemmas": "string"}
#: For ``batches.measured``.
MEASURE = counts, COUNTS


def _over(a: str, b: str, scale: int = 1) -> Column:
    return F.when(F.col(b) > 0, scale * F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def complexity_columns(notebook: bool = False) -> list[Column]:
    """The nine complexity metrics from ``COUNTS``.

    ``notebook`` counts punctuation among the tokens, divides all distinct forms by the
    tokens that aren't punctuation, counts adverbial modifiers as lexical, and doesn't round.
    """
    show = (lambda c, n: c) if notebook else F.round
    tokens = "rows" if notebook else "plain"
    return [
        show(_over(tokens, "clauses"), 2).alias("MLC"), show(_over(tokens, "sentences"), 2).alias("MLS"), show(_over("dependent", "clauses"), 2).alias("DCC"), show(_over("coordinated", "clauses"), 2).alias("CPC"),
        show(_over("depths", "blocks"), 2).alias("profundidade_media"), F.col("deepest").cast("int").alias("profundidade_max"),
        show(_over("all_types", "words") if notebook else _over("types", "plain"), 4).alias("ttr"), show(_over("content_or_adverbial" if notebook else "content", tokens), 4).alias("lexical_density"), F.col(tokens).cast("int").alias("token_quantity"),
    ]


def pos_columns() -> list[Column]:
    """Shares of nouns, verbs, adjectives and adverbs from ``COUNTS``, in percent."""
    return [F.round(_over(p, "open", 100), 2).alias(f"{p.lower()}_freq") for p in POS]


def complexity(df: DataFrame, key: str, text: str, notebook: bool = False) -> DataFrame:
    """The nine complexity metrics of each row, with its lemmas; see ``complexity_columns``."""
    return measured(df.select(key, F.col(text).alias("_parse")), {"_parse": MEASURE}).select(key, *complexity_columns(notebook), "lemmas")


def pos_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """Shares of nouns, verbs, adjectives and adverbs among tokens that aren't punctuation, in percent."""
    return measured(df.select(key, F.col(text).alias("_parse")), {"_parse": MEASURE}).select(key, *pos_columns())
