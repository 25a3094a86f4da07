"""Models in batches."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quilate.operators import inference, standins
from quilate.operators.frames import MissingColumns


def texts(spark, n=100, parts=2):
    return spark.range(n, numPartitions=parts).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))


def test_batches_are_bounded_and_the_model_is_made_once(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        open(f"{folder}/made-{uuid.uuid4().hex}", "w").close()

        def model(batch):
            with open(f"{folder}/batch-{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(batch)))
            return [{"label": "POSITIVE", "score": 0.5} for _ in batch]

        return model

    got = inference.sentiment(texts(spark, 100, 2), "text", make).collect()
    assert len(got) == 100 and {r.sentiment_normalized for r in got} == {"positive"}
    sizes = sorted(int(p.read_text()) for p in tmp_path.glob("batch-*"))
    assert sizes == [18, 18, 32, 32]  # two tasks of 50 rows
    assert 1 <= len(list(tmp_path.glob("made-*"))) <= 2


def test_a_failing_batch_is_unknown(spark):
    def make():
        def model(batch):
            if any(x.endswith(" 40") for x in batch):
                raise RuntimeError("out of memory")
            return [[{"label": "LABEL_2", "score": 0.9}, {"label": "LABEL_0", "score": 0.1}] for _ in batch]

        return model

    rows = texts(spark, 100, 1).unionAll(spark.createDataFrame([(500, None), (501, "")], "id bigint, text string"))
    got = {r.id: (r.sentiment_label, r.sentiment_score, r.sentiment_normalized) for r in inference.sentiment(rows, "text", make).collect()}
    assert len(got) == 100
    assert {k for k, v in got.items() if v == ("UNKNOWN", 0.0, "unknown")} == set(range(32, 64))
    assert got[0] == ("LABEL_2", 0.9, "positive")


def test_a_model_that_loses_results_is_a_failure(spark):
    got = inference.sentiment(texts(spark, 5, 1), "text", lambda: lambda batch: [{"label": "A", "score": 1.0}]).collect()
    assert {r.sentiment_label for r in got} == {"UNKNOWN"}


def test_summary(spark):
    judged = spark.createDataFrame([("a", "x", 0.2), ("a", "x", 0.4), ("b", "x", 1.0), ("b", None, 0.5)], "sentiment_normalized string, g string, sentiment_score double")
    got = {(r.g, r.sentiment_normalized): (r["count"], r.percentage, round(r.score_mean, 6)) for r in inference.sentiment_summary(judged, ["g"]).collect()}
    assert got == {("x", "a"): (2, 66.67, 0.3), ("x", "b"): (1, 33.33, 1.0), (None, "b"): (1, 100.0, 0.5)}
    assert {r.sentiment_normalized: r.percentage for r in inference.sentiment_summary(judged).collect()} == {"a": 50.0, "b": 50.0}
    with pytest.raises(MissingColumns):
        inference.sentiment(judged, "text", standins.length_classifier)


def test_vectors_are_those_of_the_first_token(spark):
    rows = spark.createDataFrame([(1, "aeae"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in inference.sentence_vectors(rows, "text", standins.vowel_encoder).collect()}
    assert got[1] == [0.5, 0.5, 0.0, 0.0, 0.0] and got[2] == got[3] == [0.0] * 5


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Hello there, world!", 9), (2, None, 9), (3, "", 9), (4, "naïve 中文 " * 300, 9)]
    got = {r.id: r.tokens for r in inference.token_counts(spark.createDataFrame(rows, "id int, text string, tokens int"), "text", path).collect()}
    library = Tokenizer.from_file(path)
    assert got == {i: len(library.encode(t or "").ids) for i, t, _ in rows}
    cost = inference.prompt_cost(spark.createDataFrame([("u", 10), ("u", 5)], "role string, tokens int"), ["role"], per_million=2.0).first()
    assert tuple(cost) == ("u", 2, 15, 7.5, 0.00003)


def test_stand_ins():
    assert standins.length_classifier()(["ab"])[0][0] == {"label": "LABEL_2", "score": 3 / 98}
    assert np.allclose(standins.vowel_encoder()(["a", ""])[:, 0, 0], [1, 0])
