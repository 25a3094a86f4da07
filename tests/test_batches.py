"""Metrics that are counted in Arrow batches: no shuffle, and results of parses that aren't well formed."""

import pyarrow as pa
from pyspark.sql import functions as F

from quilate.functions import text as T
from quilate.operators import batches, conllu, metrics, themes
from quilate.plans.catalogue import QUERIES
from quilate.sources.tables import spread


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parses_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "1\ta\ta\tNOUN")], "id int, parse string")
    assert "Aggregate" not in plan(conllu.complexity(df, "id", "parse")) and "Generate" not in plan(conllu.complexity(df, "id", "parse"))
    assert "MapInArrow" in plan(conllu.pos_frequencies(df, "id", "parse"))


def test_metrics_in_one_pass(spark):
    df = spark.createDataFrame([(1, "Casa.", "1\ta\ta\tNOUN", ["PER"])], "id int, t string, parse string, e array<string>")
    one = plan(metrics.analyzed(df, "id", "t", "parse", "e"))
    assert "Join" not in one and "Aggregate" not in one and one.count("MapInArrow") == 1
    flesch = plan(QUERIES["flesch"][0](spark, "/root/testdata/sf0.001"))
    assert "Join" not in flesch and "Aggregate" not in flesch


def test_odd_parses(spark):
    row = lambda *x: "\t".join(x)
    short, loop = row("1", "a"), "\n".join(row(str(i), f, f.lower(), "NOUN", "_", "_", h, "acl") for i, f, h in ((1, "A", "2"), (2, "B", "1")))
    text = "# c\n" + short + "\n\n \n\n" + loop + "\n \t\n# only a comment"
    got = {k: v[0] if isinstance(v, list) else v[0] for k, v in ((n, pa.array(x).to_pylist()) for n, x in conllu.counts(pa.array([text, None, ""])).items())}
    assert (got["rows"], got["plain"], got["sentences"], got["blocks"], got["all_types"], got["types"]) == (3, 2, 2, 3, 3, 2)
    assert got["lemmas"] == "a b" and got["dependent"] == 2 and got["NOUN"] == 2
    empty = conllu.complexity(spark.createDataFrame([(1, None), (2, "")], "id int, parse string"), "id", "parse").collect()
    assert all(r["MLS"] == 0 and r["lemmas"] == "" and r["profundidade_max"] == 0 for r in empty)


def test_word_counts_equal_the_expressions(spark):
    words = ["pai", "casa", "coração", "brasileiro", "ideia", "saúde", "2024", "uai", "the_x", "straße", "日本語"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.length("w").alias("n"), T.syllables(F.col("w")).alias("y"))
    want = df.agg(F.sum("n"), F.sum("y"), F.count_if(F.col("n") > 6)).first()
    got = metrics.word_counts(pa.array([[words[:4], words[4:]], [], None, [[]]]))
    assert (got["chars"][0], got["syl"][0], got["long"][0]) == tuple(want) and got["k2"].tolist() == [16 + 49, 0, 0, 0]
    assert got["s"].tolist() == [2, 0, 0, 1] and got["k"].tolist() == [11, 0, 0, 0]


def test_slices_are_bounded_and_whole():
    batch = pa.record_batch({"k": pa.array(range(100)), "t": pa.array(["x" * 1000] * 100)})
    parts = list(batches.slices(batch, [1], 10_000))
    assert len(parts) >= 10 and [k for p in parts for k in p.column(0).to_pylist()] == list(range(100))


def test_pairs_of_tags_without_a_join(spark):
    lists = [["a", "b", "", "a"], ["a", "b", "c"], [None, "c"], None, []] * 3
    df = spark.createDataFrame(list(enumerate(lists)), "id int, tags array<string>")
    rows = df.select("id", F.explode(F.array_distinct(F.filter("tags", lambda x: x != ""))).alias("tag"))
    got = themes.top_in_lists(df, "tags", 2)
    assert sorted(got.collect()) == sorted(themes.top_together(rows, "id", "tag", 2).collect()) and got.count() == 2
    assert "Join" not in plan(got) and "Join" not in plan(QUERIES["tag_cooc"][0](spark, "/root/testdata/sf0.001"))


def test_latin_words_are_whole_runs(spark):
    texts = ["Abc ab日 日ab a ab×cd naïve_x x1 Ÿz Öl", "É", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.latin_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [["abc", "ab", "cd", "ÿz", "öl"], [], []]


def test_texts_are_dealt_in_parts_of_bounded_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert spread(docs, 1 << 20).rdd.getNumPartitions() >= 14
