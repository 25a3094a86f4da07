"""Scores as text: rounded by their exact binary value."""

import duckdb
from pyspark.sql import functions as F

from quilate.functions import text as T
from quilate.operators import lexical
from quilate.plans.catalogue import QUERIES


def test_report_rounds_like_its_sql(spark, tmp_path):
    words = [("de", "alpha")] * 26 + [("de", "beta")] * 3 + [("en", "alpha")] * 7 + [("en", "beta")] * 8
    rows = [(i, w, lang) for i, (lang, w) in enumerate(words)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    f, sql = QUERIES["logodds_report"]
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    # the z-score 5.385 is a little less in binary
    assert [tuple(r) for r in f(spark, str(tmp_path)).collect()] == oracle.sql(sql).fetchall() == [("alpha: 5.38",)]


def test_fixed_digits(spark):
    values = [20.305, 2.125, 2.135, -0.001, 5e-05, 0.0, 1e15 + 0.5, None, float("nan"), *[k / 1000 for k in range(5, 20000, 10)]]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("x", T.fixed(F.col("x"), 2).alias("a"), T.fixed(F.col("x"), 4).alias("b")).collect()
    assert len(got) == len(values)
    for r in got:
        assert (r.a, r.b) == ((None, None) if r.x is None else ("%.2f" % r.x, "%.4f" % r.x))


def test_cells_show_scores_as_they_are(spark):
    """Scores equal in nine digits are ties, but each is printed unrounded."""
    # 0.12345 is 0.123450000000000004 in binary, so rounding to nine digits first would give 0.1235
    scores = spark.createDataFrame([("a", "y", 0.12344999996), ("a", "x", 0.12344999995), ("a", "z", 0.1)], "lang string, term string, score double")
    top = lexical.top_terms(scores, 2, digits=9)
    assert [r.a for r in lexical.wide(top, ["a"]).orderBy("rank").collect()] == ["x (0.1234)", "y (0.1234)"]
