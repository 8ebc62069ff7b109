"""What keeps searches in proportion to the index: what goes along with tasks, what lies together, what is not shuffled."""

import re

from pyspark.sql import functions as F

from vellum.operators import index, search
from vellum.operators import service as S
from vellum.plans import service


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().sparkPlan().toString()


def test_few_queries_go_to_the_vectors(spark):
    """Where nothing is broadcast by size, queries and vectors were a product that reads one side anew for each part of the other."""
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "doc_id long, vec array<double>")
    queries = vectors.where("doc_id < 3").withColumnRenamed("doc_id", "qid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        scored = search.dense_scores(queries, "qid", vectors, "doc_id")
        assert "CartesianProduct" not in plan_of(scored) and scored.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks_are_built_and_scored_where_texts_lie(spark, tmp_path):
    """A super-range of blocks is in one file, and scores meet by range before any is shuffled."""
    rows = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("w0 w"), F.col("id") % 50, F.lit(" w0")).alias("text"))
    made = index.build(rows, str(tmp_path / "i"), "k", "text")
    files = made.every("blocks").select(F.floor(F.col("range") / index.RANGE).alias("super"), F.input_file_name().alias("f")).groupBy("super").agg(F.countDistinct("f").alias("n"))
    assert files.count() >= 3 and {r.n for r in files.collect()} == {1}
    asked = spark.createDataFrame([(1, "w0"), (1, "w7"), (2, "w7")], "qid long, tok string")
    scores = made.sparse_scores(asked, "qid")
    assert scores.where("qid = 2").count() == 60 and scores.where("qid = 1").count() == 3000
    scores.collect()
    assert scores._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning(_at") == 1
    beside = made.points.where("k % 2 = 0").select("k", (F.col("k") % 5).alias("five"))
    assert {(r.k, r.five) for r in made.sparse_scores(asked, "qid", beside).where("qid = 2").collect()} == {(k, k % 5) for k in range(3000) if k % 50 == 7 and k % 2 == 0}
    assert {(r.k, r.five) for r in made.sparse_scores(asked, "qid", beside).where("qid = 1").collect()} == {(k, k % 5) for k in range(0, 3000, 2)}


SMOKE = "/root/testdata/sf0.001"


def test_terms_and_lookups_from_sql_need_no_index(spark, monkeypatch):
    """They built the whole search index before; and a lookup met every paragraph of its file, a range of seq at a time."""

    def never(*_):
        raise AssertionError("an index")

    monkeypatch.setattr(service, "built", never)
    assert service.sql_define_term(spark, SMOKE).count() > 0
    found = service.sql_get_paragraph(spark, SMOKE)
    assert found.count() > 0 and not re.search(r"Join Inner,.*[<>]= ", found._jdf.queryExecution().optimizedPlan().toString())


def test_requests_of_a_table_do_not_go_beside_points(spark):
    """The vectors of requests meet points as the lists are written, few requests sent along; what SQL reads is the lists."""
    assert "zip_with" not in service.sql_search(spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    made, vectors = service.built(spark, SMOKE), spark.read.parquet(f"{SMOKE}/embeddings.parquet").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        asked = S.policy(service.requests(spark, SMOKE)).where("error is null")
        hits = S.ranked_hits(made, asked, asked.select("qid").join(vectors, "qid"), made.points.select("point", "doc_id").join(vectors.withColumnRenamed("qid", "doc_id"), "doc_id").select("point", "vec"))
        assert "CartesianProduct" not in plan_of(hits)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hashes_of_texts_stay_arrays(spark):
    """A task made Python lists of all hashes of ten thousand texts before; now it sends rows on as arrays."""
    from vellum.operators.containment import least_hashes, marked

    texts = [" ".join(f"w{i * k % 97}" for k in range(300)) for i in range(1, 30)] + ["short", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string").coalesce(1)
    assert least_hashes(texts[0]).dtype == "int64"
    assert sorted((r.k, r._h) for r in marked(rows, ["k"], "t").collect()) == sorted((i, h) for i, t in enumerate(texts) for h in least_hashes(t).tolist())
