"""Embedding files: round trips, what other programs see, commit and abort."""

import glob
import json
import os
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from quilate.sources import arrays


def saved(df, path, kind, **options):
    df.write.format("embedding_files").options(kind=kind, **options).mode(options.pop("mode", "overwrite")).save(path)


@pytest.fixture(scope="module")
def vectors(spark):
    arrays.registered(spark)
    return spark.range(1000, numPartitions=4).select("id", F.array(*[(F.col("id") * (k + 1) % 17).cast("float") for k in range(5)]).alias("embedding"))


@pytest.mark.parametrize("kind", ["npy", "pkl"])
def test_round_trip(spark, vectors, tmp_path, kind):
    path = f"file://{tmp_path}/e"
    saved(vectors, path, kind, rows="300")
    back = spark.read.format("embedding_files").option("kind", kind).load(path)
    assert back.schema.simpleString() == "struct<id:bigint,embedding:array<float>>"
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vectors.collect()))
    meta = json.loads((tmp_path / "e/metadata.json").read_text())
    assert (meta["rows"], meta["dimensions"]) == (1000, 5)
    assert not [f for f in os.listdir(tmp_path / "e") if f.startswith("_writing")]
    saved(vectors.where("id < 10"), path, kind, rows="4")  # overwrites
    again = spark.read.format("embedding_files").option("kind", kind).load(path)
    assert again.count() == 10 and again.rdd.getNumPartitions() >= 3
    vectors.where("id >= 990").write.format("embedding_files").option("kind", kind).mode("append").save(path)
    assert spark.read.format("embedding_files").option("kind", kind).load(path).count() == 20


def test_other_programs_read_the_files(spark, vectors, tmp_path):
    saved(vectors, f"file://{tmp_path}/n", "npy")
    files = [f for f in glob.glob(f"{tmp_path}/n/*.npy") if not f.endswith(".ids.npy")]
    whole = {int(k): v.tolist() for f in files for k, v in zip(np.load(f[:-4] + ".ids.npy"), np.load(f), strict=True)}
    assert len(whole) == 1000 and whole[7] == [7.0, 14.0, 4.0, 11.0, 1.0]
    saved(vectors, f"file://{tmp_path}/p", "pkl")
    packs = [pickle.load(open(f, "rb")) for f in glob.glob(f"{tmp_path}/p/*.pkl")]
    assert sorted(i for p in packs for i in p["ids"]) == list(range(1000)) and packs[0]["embeddings"].dtype == np.float32


def test_arrays_without_keys_are_numbered(spark, tmp_path):
    arrays.registered(spark)
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float64).reshape(3, 2))
    np.save(tmp_path / "b.npy", np.ones((2, 2), np.float32))
    rows = spark.read.format("embedding_files").load(f"file://{tmp_path}").orderBy("id").collect()
    assert [(r.id, r.embedding) for r in rows] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0])]


def test_failed_writes_leave_nothing(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/f"
    broken = vectors.withColumn("embedding", F.when(F.col("id") < 990, F.col("embedding")))
    with pytest.raises(Exception, match="is null"):
        saved(broken, path, "npy", rows="50")
    uneven = vectors.withColumn("embedding", F.when(F.col("id") < 500, F.col("embedding")).otherwise(F.array(F.lit(1.0).cast("float"))))
    with pytest.raises(Exception, match="length"):
        saved(uneven, path, "npy")
    assert not glob.glob(f"{tmp_path}/f/**/*.npy", recursive=True)


def test_pickles_run_no_code(spark, tmp_path):
    arrays.registered(spark)
    (tmp_path / "x.pkl").write_bytes(b"cos\nsystem\n(S'true'\ntR.")
    with pytest.raises(Exception, match="isn't allowed"):
        spark.read.format("embedding_files").option("kind", "pkl").load(f"file://{tmp_path}").collect()
