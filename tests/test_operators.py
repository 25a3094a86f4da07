"""Operators that have no SQL form, and edge cases."""

import pytest
from pyspark.sql import functions as F

from quilate.functions import text as T
from quilate.operators import enrich, graphs, prompts, stats, vectors
from quilate.plans import further  # noqa: F401
from quilate.plans.catalogue import QUERIES


def test_syllables(spark):
    words = {"pai": 1, "casa": 2, "coração": 2, "brasileiro": 3, "ideia": 1, "saúde": 2, "2024": 1, "": 0, "uai": 1, "não-binária": 4, "Piauí": 1}
    df = spark.createDataFrame(list(words.items()), "w string, n int")
    assert df.where(T.syllables(F.col("w")) != F.col("n")).collect() == []


def test_persona_grid_and_ids(spark):
    grid = prompts.personas(spark)
    assert grid.count() == 75
    templates = spark.createDataFrame([(f"t{i}", f"Descreva {{{{genero}}}} {i}") for i in range(8)], "template_name string, original_prompt string")
    m = prompts.messages(grid, templates, list("abcdef"))
    assert m.count() == 3600 and m.select("messageId").distinct().count() == 3600


def test_pending_and_call(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "z")], "id string, text string")
    done = spark.createDataFrame([("a",), ("c",), ("c",)], "id string")
    assert sorted(r["id"] for r in enrich.pending(items, done, "id", 2).collect()) == ["a", "b", "b"]

    def connect():
        def ask(x):
            if x == "bad":
                raise ValueError("no")
            return x.upper()

        return ask

    called = enrich.call(items, "id", "text", connect)
    assert {r["id"]: r["response"] for r in called.collect()} == {"a": "X", "b": None, "c": "Z"}
    assert [r["error"] for r in enrich.dead_letters(called, "id", "text").collect()] == ["ValueError: no"]


def test_components(spark, tmp_path):
    nodes = spark.range(7).withColumnRenamed("id", "n")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "i bigint, j bigint")
    found = {r["node"]: r["component"] for r in vectors.components(edges, nodes, "n", f"file://{tmp_path}").collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def label_propagation_of(edges, nodes):
    near = {n: {} for n in nodes}
    for i, j, w in edges:
        near[i][j] = near[j][i] = w
    label = {n: n for n in nodes}
    while True:
        asked = {}
        for n in nodes:
            votes = {}
            for m, w in near[n].items():
                votes[label[m]] = votes.get(label[m], 0) + w
            top = max(votes.values(), default=0)
            if top > votes.get(label[n], 0):
                asked[n] = min(x for x in votes if votes[x] == top)
        if not asked:
            return label
        label |= {n: x for n, x in asked.items() if not any(m in asked and m < n for m in near[n])}


def test_label_propagation_runs_until_stable(spark, tmp_path):
    # a path whose synchronous labels swap for ever, two triangles with a weak link, an isolated node
    edges = [(i, i + 1, 0.5) for i in range(11)]
    edges += [(20, 21, 1.0), (21, 22, 1.0), (20, 22, 1.0), (30, 31, 1.0), (31, 32, 1.0), (30, 32, 1.0), (22, 30, 0.25)]
    names = [*range(12), 20, 21, 22, 30, 31, 32, 40]
    df = spark.createDataFrame(edges, "i bigint, j bigint, weight double")
    nodes = spark.createDataFrame([(n,) for n in names], "n bigint")
    found = {r["node"]: r["label"] for r in graphs.label_propagation(df, nodes, "n", f"file://{tmp_path}").collect()}
    assert found == label_propagation_of(edges, names) and found[40] == 40
    assert len({found[n] for n in (20, 21, 22)}) == len({found[n] for n in (30, 31, 32)}) == 1 and found[20] != found[30]


@pytest.mark.parametrize("name", ["label_prop", "louvain"])
def test_isolated_nodes_stay(spark, name):
    sf = "/root/testdata/sf0.001"
    nodes = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id") % 50).distinct().count()
    assert QUERIES[name][0](spark, sf).select("node").distinct().count() == nodes


def test_sum_of_squares_adds_up(spark):
    rows = [(i, i % 3, [float(i), float(i * i % 7)]) for i in range(20)]
    q = vectors.cluster_quality(spark.createDataFrame(rows, "id bigint, g int, embedding array<double>"), "g").first()
    assert q["tss"] == pytest.approx(q["wcss"] + q["bcss"])


def test_studentised_range():
    # published table values: q(0.95; 3, 10) = 3.877, q(0.99; 3, 10) = 5.270
    assert stats.studentised_range_quantile(0.95, 3, 10) == pytest.approx(3.877, abs=0.01)
    assert stats.studentised_range_quantile(0.99, 3, 10) == pytest.approx(5.270, abs=0.02)


def test_entry_imports_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quilate", tmp_path / "quilate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False"], said.stderr


def test_resamples_have_exactly_the_rows_of_their_group(spark):
    from quilate.operators import stats

    df = spark.range(120).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("v")).where("g < 2 OR id < 20")
    drawn = stats.resampled(df, "id", "g", carry=("v",), resamples=7)
    sizes = {(r.g, r.b): r.n for r in drawn.groupBy("g", "b").agg(F.sum("times").alias("n")).collect()}
    n = {r.g: r.n for r in df.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(g, b): n[g] for g in n for b in range(1, 8)}
    rows = drawn.collect()
    assert all(r.v == r.id * 1.5 and r.id % 3 == r.g and r.times >= 1 for r in rows)
    assert len({(r.id, r.b) for r in rows}) == len(rows) and max(r.times for r in rows) > 1
    whole = stats.resampled(df, "id", resamples=3).groupBy("b").agg(F.sum("times").alias("n")).collect()
    assert {r.n for r in whole} == {df.count()}


@pytest.mark.parametrize("block", [7, 1 << 17])
def test_means_of_resamples_without_rows_of_draws(spark, block):
    rows = [(i, "ab"[i % 2] if i % 5 else None, None if i % 11 == 0 else i * 0.37) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, g string, v double")
    drawn = stats.resampled(df.where("v IS NOT NULL"), "id", "g", carry=("v",), resamples=6)
    want = {(r.g, r.b): r.m for r in drawn.groupBy("g", "b").agg((F.sum(F.col("times") * F.col("v")) / F.sum("times")).alias("m")).collect()}
    means = stats.resampled_means(df, "id", "v", "g", resamples=6, block=block)
    assert {(r.g, r.b): r._m for r in means.collect()} == pytest.approx(want) and len(want) == 18
    # draws are packed before they are shuffled
    assert "FlatMapCoGroupsInPandas" in stats.bootstrap_interval(df, "id", "v", "g")._jdf.queryExecution().optimizedPlan().toString()
