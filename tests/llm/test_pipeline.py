"""The corpus pipeline, stage by stage, on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(31)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ala", "emo", "ipo", "uro", "anti", "esto")]
    line = lambda n=12: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    shared, passage = "all rights reserved by nobody", line(40)
    out = [(i, "\n".join([line(), shared, line(20), line(9)]), "en", "web") for i in range(40)]
    out += [(100 + i, out[i][1], "en", "web") for i in range(5)]  # copies
    out += [(200, line(10) + " " + passage + " " + line(10), "en", "web"), (201, line(10) + " " + passage + " " + line(11), "en", "web")]
    out += [(300, "too few words", "en", "web"), (301, None, None, None), (302, "", "en", "web"), (303, "same same " * 60, "en", "web")]
    return [(d, t, g, s, len(t or "")) for d, t, g, s in out]


def test_stages(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        seen[name] = rows
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame([tuple(x) for x in rows], SCHEMA)
    kept = {x.doc_id: x for x in seen["quality rules"]}
    assert set(kept) == {d for d, *_ in corpus} - {300, 301, 302, 303}
    cut = {x.doc_id: x for x in seen["line dedup"]}
    assert set(cut) == set(kept) and sum("all rights" in x.text for x in cut.values()) == 1 and all(cut[100 + i].text == "" for i in range(5)) and all(x.n_chars == len(x.text) for x in cut.values())
    single = {x.doc_id: x for x in seen["n-gram Jaccard join"]}
    assert set(single) == set(cut)  # emptied documents link with nothing
    last = {x.doc_id: x for x in seen["substring dedup"]}
    words = lambda x: x.text.split()
    assert set(last) == set(single) and len(words(last[201])) == len(words(single[201])) - 40 and words(last[200]) == words(single[200])
    packed = seen["best-fit packing"]
    assert {x.doc_id for x in packed} == set(last) and all(x.offset + x.length <= 2048 for x in packed)


def test_copies_without_line_dedup_leave_one_document(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    got = {x.doc_id for x in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()}
    assert got == {d for d, *_ in corpus} - {100 + i for i in range(5)}


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
