"""Readers, writers, stores, the stream and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quilate import cli
from quilate.operators import frames
from quilate.sources import scratch, stores, tables
from quilate.streaming.incremental import enrich_stream


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted"\ncell'), (2, "plain, with comma"), (3, None)]
    stores.write_csv(spark.createDataFrame(rows, "id int, text string"), f"file://{tmp_path}/c")
    got = tables.read_csv(spark, f"file://{tmp_path}/c", "id int, text string").collect()
    assert sorted(map(tuple, got)) == rows


def test_first_existing_source(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/b")
    assert tables.read_first(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_first(spark, [f"file://{tmp_path}/none"])


def test_traits_and_templates(spark, tmp_path):
    (tmp_path / "traits.json").write_text(json.dumps({"genero": ["homem", "mulher"], "raca": ["preta"]}))
    assert {(r.trait, r.value) for r in tables.read_traits(spark, f"file://{tmp_path}/traits.json").collect()} == {("genero", "homem"), ("genero", "mulher"), ("raca", "preta")}
    (tmp_path / "one.tmplt").write_text("Descreva {{genero}}\n")
    (tmp_path / "other.txt").write_text("no")
    found = tables.read_templates(spark, f"file://{tmp_path}").collect()
    assert [r.template_name for r in found] == ["one"] and found[0].original_prompt.strip() == "Descreva {{genero}}"


def test_nested_json_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "model string, prompt string, n int")
    tables.write_nested_json(df, f"file://{tmp_path}/j", "model", "prompt")
    assert spark.read.json(f"file://{tmp_path}/j").where("prompt = 'y'").select("n").first()[0] == 2
    tables.write_report(df, f"file://{tmp_path}/r", "%s: %d", "prompt", "n")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/r").collect()) == ["x: 1", "y: 2"]
    stores.write_grouped_report(df, f"file://{tmp_path}/g", "prompt", "%s=%d", "model", "n")
    assert sorted((r.prompt, r.value) for r in spark.read.text(f"file://{tmp_path}/g").collect()) == [("x", "a=1"), ("y", "a=2")]
    assert stores.pretty({"a": "x" * 90, "b": [1]}) == f"a: {'x' * 80}...\nb: [1]"


def test_records(spark, tmp_path):
    assert stores.record_path("/p/describe.tmplt") == "/p/rendered/describe"
    with pytest.raises(ValueError):
        stores.record_path("/p/describe.txt")
    messages = spark.createDataFrame([("m1", "q1"), ("m2", "q2")], "messageId string, message string")
    responses = spark.createDataFrame([("m1", "r1", "a1")], "messageId string, responseId string, response string")
    parses = spark.createDataFrame([("r1", "p1")], "responseId string, udpipe_result string")
    stores.save_record({"messages": messages, "responses": responses}, f"file://{tmp_path}/one")
    stores.save_record({"messages": messages, "responses": responses, "parses": parses}, f"file://{tmp_path}/two")
    wide = stores.load_records(spark, f"file://{tmp_path}", ["one", "two"])
    rows = {(r.template, r.messageId): r for r in wide.collect()}
    assert rows["two", "m1"].udpipe_result == "p1" and rows["two", "m2"].response == "" and rows["one", "m1"].udpipe_result is None
    assert sorted(r["messageId"] for r in stores.rows_of(messages)) == ["m1", "m2"]


def test_checkpoints_resume(spark, tmp_path):
    items, seen = spark.range(20).withColumnRenamed("id", "k"), []
    store = stores.Checkpoint(spark, f"file://{tmp_path}/ck")

    def work(part):
        seen.append(part.count())
        if len(seen) == 3:
            raise KeyboardInterrupt
        return part.withColumn("v", F.col("k") * 2)

    with pytest.raises(KeyboardInterrupt):
        stores.resumed(items, "k", work, store, parts=4)
    kept = store.load().count()
    assert kept == seen[0] + seen[1] < 20
    found = stores.resumed(items, "k", work, store, parts=4)
    assert sorted((r.k, r.v) for r in found.collect()) == [(k, 2 * k) for k in range(20)] and sum(seen[3:]) == 20 - kept
    store.clean()
    assert store.load() is None


def test_embedding_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "responseId string, embedding array<float>")
    stores.save_embeddings(df, f"file://{tmp_path}/e", formats=("parquet", "npy", "pkl"))
    loaded = stores.load_embeddings(spark, f"file://{tmp_path}/e")
    assert stores.embedding(loaded, "b").tolist() == [3.0, 4.0] and stores.embedding(loaded, "z") is None
    assert [r.responseId for r in stores.embeddings_of(loaded, ["a", "a", "q"]).collect()] == ["a"]
    for kind in ("npy", "pkl"):
        back = stores.load_embeddings(spark, f"file://{tmp_path}/e", kind=kind)
        assert sorted((r.responseId, r.embedding) for r in back.collect()) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
        assert [r.responseId for r in stores.embeddings_of(back, ["b", "q"]).collect()] == ["b"]
        assert stores.embedding(back, "a").tolist() == [1.0, 2.0]
    with_more = stores.load_with_metadata(spark, f"file://{tmp_path}/e", spark.createDataFrame([("a", "x")], "responseId string, genero string"))
    assert {(r.responseId, r.genero) for r in with_more.collect()} == {("a", "x"), ("b", None)}
    meta = spark.read.json(f"file://{tmp_path}/e/metadata").first()
    assert (meta.n, meta.dimensions) == (2, 2)
    wide = spark.createDataFrame([("a", 1.0, 2.0)], "responseId string, d0 double, d1 double")
    wide.write.parquet(f"file://{tmp_path}/w")
    assert stores.load_embeddings(spark, f"file://{tmp_path}/w").first().embedding == [1.0, 2.0]


def test_frames(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, response_text string, c double")
    with pytest.raises(frames.MissingColumns):
        frames.require(df, "a", "zz")
    assert frames.numeric(df, "response_text").columns == ["a", "response_text", "c"] and frames.numeric(df).columns == ["a", "c"]
    assert frames.named_like(df, "response") == ["response_text"]
    assert frames.with_defaults(df, a=5, udpipe="").first().asDict() == {"a": 1, "response_text": "x", "c": 2.0, "udpipe": ""}
    assert frames.new_columns(df, df.withColumn("n", F.lit(1))) == ["n"]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Cluster()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_stream_takes_each_file_once(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint, text string").schema
    run = lambda: enrich_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", schema, lambda df: df.withColumn("n", F.length("text"))).awaitTermination(60)
    spark.createDataFrame([(1, "ab"), (2, None)], schema).write.parquet(f"file://{tmp_path}/in")
    run()
    spark.createDataFrame([(3, "abc")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    run()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.id, r.n) for r in got.collect()) == [(1, 2), (2, None), (3, 3)]


def test_command_line(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "describe.tmplt").write_text("Descreva uma pessoa {{genero}} {{raca}}.")
    (tmp_path / "traits.json").write_text(json.dumps({"genero": ["homem", "mulher"], "raca": ["preta", "branca"]}))
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "m.json").write_text(json.dumps({"model": "gpt-4o"}))
    cli.main(["promptl", "--prompt_path", f"{at}/p", "--trait_list_path", f"{at}/traits.json", "--model_config_folder", f"{at}/models"])
    messages = spark.read.parquet(f"{at}/p/rendered/messages")
    assert messages.count() == 4 and messages.where("message = 'Descreva uma pessoa mulher preta.'").count() == 1
    stores.save_record({"messages": messages.where("template_name = 'describe'").drop("template_name")}, f"{at}/p/rendered/describe")
    ask = ["call_llm", "--record_path", f"{at}/p/rendered/describe", "--registry", "tests.stub_connectors:chat_registry", "--ntimes", "2"]
    cli.main(ask)
    cli.main(ask)
    responses = spark.read.parquet(f"{at}/p/rendered/describe/responses")
    assert responses.count() == 8 and responses.select("responseId").distinct().count() == 8
    cli.main(["to_parquet", "--record_folder", f"{at}/p/rendered", "--templates", "describe", "--output_file", f"{at}/wide"])
    wide = spark.read.parquet(f"{at}/wide")
    assert wide.count() == 8
    cli.main(["generate_prompt_stats", "--record_folder", f"{at}/p/rendered", "--templates", "describe"])
    cli.main(["add_text_metrics", "--input_file", f"{at}/wide", "--output_file", f"{at}/metrics", "--parts", "2"])
    m = spark.read.parquet(f"{at}/metrics")
    assert m.count() == 8 and m.where("avg_word_length > 0").count() == 8 and "_row" not in m.columns
    cli.main(["ctf_idf", "--model_name", "gpt-4o", "--agg_column", "genero", "--data_file", f"{at}/wide", "--output_dir", f"{at}/tfidf"])
    assert spark.read.csv(f"{at}/tfidf/gpt-4o_genero", header=True).columns == ["rank", "homem", "mulher"]
    cli.main(["masked_personas", "--input_file", f"{at}/wide", "--target_col", "genero", "--target_name", "mulher", "--unmarked_name", "homem", "--output_dir", f"{at}/odds"])
    assert spark.read.text(f"{at}/odds").columns == ["value"]
    cli.main(["sentiment", "--input_file", f"{at}/wide", "--output_dir", f"{at}/s", "--connector", "tests.stub_connectors:sentiment_model", "--text_column", "response"])
    assert {r.sentiment_label for r in spark.read.parquet(f"{at}/s/sentiment").select("sentiment_label").distinct().collect()} == {"negative"}


def test_a_signal_stops_a_job_and_it_goes_on_later(spark, tmp_path):
    import os
    import signal
    import threading
    import time

    store = stores.Checkpoint(spark, f"file://{tmp_path}/partial")
    items = spark.range(40).withColumnRenamed("id", "k")
    turns = []

    def work(df):
        turns.append(1)
        slow = len(turns) == 2

        def run(batches):
            for pdf in batches:
                if slow and len(pdf):
                    time.sleep(120)
                yield pdf

        return df.mapInPandas(run, "k bigint")

    def later():
        while len(turns) < 2:
            time.sleep(0.1)
        time.sleep(4)
        os.kill(os.getpid(), signal.SIGTERM)

    before = signal.getsignal(signal.SIGTERM)
    threading.Thread(target=later, daemon=True).start()
    begin = time.time()
    with pytest.raises(stores.Interrupted, match="SIGTERM"):
        stores.resumed(items, "k", work, store, parts=3)
    assert time.time() - begin < 100 and signal.getsignal(signal.SIGTERM) is before
    saved = store.load().count()
    assert 0 < saved < 40  # the first part
    assert sorted(r.k for r in stores.resumed(items, "k", lambda df: df, store, parts=3).collect()) == list(range(40))
    with pytest.raises(ZeroDivisionError):  # other errors pass
        with stores.stoppable(spark):
            1 / 0
