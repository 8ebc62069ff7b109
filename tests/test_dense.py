"""The dense index: recall of the best 50 with and without a filter, what it reads, hot codes, edges."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import dense, search

DIR = "/root/testdata/sf0.1"


def exact(vectors, asked, k, where=None):
    rows = vectors if where is None else vectors.where(where)
    found = search.top(search.dense_scores(asked, "qid", rows, "vid"), "qid", "vid", k)
    return {(r.qid, r.vid) for r in found.collect()}


def recall(index, vectors, asked, k, where=None):
    want, got = exact(vectors, asked, k, where), {(r.qid, r.vid) for r in index.top(asked, "qid", k, where).collect()}
    assert len(got) <= len(want)
    return len(want & got) / len(want)


def clustered(spark, n=3000, dim=32):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, dim))
    some = centres[rng.integers(0, 60, n)] + 0.25 * rng.standard_normal((n, dim))
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist(), "abcd"[i % 4], i % 3) for i, v in enumerate(some)], "vid long, vec array<double>, standard string, kind int")


def test_clustered_vectors_need_few_codes(spark, tmp_path):
    vectors = clustered(spark).cache()
    made = dense.build(vectors, str(tmp_path / "d"), "vid", ["standard", "kind"])
    asked = vectors.where("vid % 40 = 0").select(F.col("vid").alias("qid"), "vec")
    assert recall(made, vectors, asked, 50) >= 0.95
    assert made.visits(50) < 0.6 * (1 << made.manifest["bits"])
    where = (F.col("standard") == "b") & (F.col("kind") == 1)
    assert recall(made, vectors, asked, 50, where) >= 0.95
    assert {(r.qid, r.vid) for r in made.top(asked, "qid", 1).collect()} == {(r.qid, r.qid) for r in asked.collect()}
    plan = made.top(asked, "qid", 50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_recall_on_the_test_vectors(spark, tmp_path):
    """They fill all directions alike, the hardest case."""
    vectors = spark.read.parquet(f"{DIR}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") % 4).alias("kind")).cache()
    made = dense.build(vectors, str(tmp_path / "d"), "vid", ["kind"])
    asked = vectors.where("vid % 50 = 7").select(F.col("vid").alias("qid"), "vec")
    assert recall(made, vectors, asked, 50) >= 0.95
    assert recall(made, vectors, asked, 50, F.col("kind") == 2) >= 0.95


def test_hot_codes_and_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "SLICE", 50)
    same = [(i, [1.0, 0.0], "a") for i in range(300)] + [(900, [0.0, 1.0], "b"), (901, None, "b")]
    vectors = spark.createDataFrame(same, "vid long, vec array<double>, standard string")
    made = dense.build(vectors, str(tmp_path / "d"), "vid", ["standard"])
    assert made.vectors.agg(F.max("slices")).first()[0] == 6
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    assert [r.vid for r in made.top(asked, "qid", 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert [r.vid for r in made.top(asked, "qid", 4, F.col("standard") == "b").collect()] == [900]
    assert made.top(asked, "qid", 4, F.col("standard") == "z").isEmpty()
    assert dense.build(vectors.limit(0), str(tmp_path / "e"), "vid").top(asked, "qid", 4).isEmpty()
