"""Sparse and dense retrieval for a table of queries at once, fused by reciprocal rank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import dot

K1, B, PREFETCH, RRF_K = 1.5, 0.75, 50, 60
SENT_ROWS = 100_000
TOKEN = r"[\p{L}\p{N}]+"


def few(rows: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """Rows of queries: marked to go along with every task, if there are `most` at most, as counted; more are left to Spark's size check."""
    return F.broadcast(rows) if len(rows.select(F.lit(1)).take(most + 1)) <= most else rows


def listed(text: Column) -> Column:
    """The tokens of a text, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, tok: a row for each token; any tokenizer with this shape will do."""
    return rows.select(key, F.explode(listed(F.col(text))).alias("tok"))


def term_counts(toks: DataFrame, key: str) -> DataFrame:
    return toks.groupBy(key, "tok").agg(F.count("*").alias("tf"))


def lengths(toks: DataFrame, key: str) -> DataFrame:
    return toks.groupBy(key).agg(F.count("*").alias("dl"))


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """The document-side BM25 weight of a token."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def ordered_tokens(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, tok: as tokens(), with each token's place."""
    return rows.select(key, F.posexplode(listed(F.col(text))).alias("pos", "tok"))


ordered_tokens.listed = listed  # an index built with a tokenizer that has this need not take its tokens row by row


def encoded(rows: DataFrame, key: str, text: str, encode) -> DataFrame:
    """key, vec: texts through an encoder, a function from a list of texts to as many vectors, in Arrow batches."""
    run = F.pandas_udf(lambda s: pd.Series([[float(x) for x in v] for v in encode(s.tolist())], dtype=object), "array<double>")
    return rows.select(key, run(F.col(text)).alias("vec"))


def postings(rows: DataFrame, key: str, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """key, tok, w: document-side BM25 weights. The average length is one row beside the table."""
    toks = tokens(rows, key, text)
    tf = term_counts(toks, key)
    dl = tf.groupBy(key).agg(F.sum("tf").alias("dl"))
    avg = dl.agg(F.avg("dl").alias("avgdl"))
    return tf.join(dl, key).crossJoin(F.broadcast(avg)).select(key, "tok", weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b).alias("w"))


def document_frequency(posted: DataFrame, n_docs: DataFrame) -> DataFrame:
    """tok, df, idf; n_docs is one row with n."""
    df = posted.groupBy("tok").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    return df.select("tok", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def vocabulary(toks: DataFrame, folder: str | None = None) -> DataFrame:
    """tok, idx: dense ids by sorted order, from 0. Numbers are given inside sorted ranges and offset by the counts before them."""
    ranged = toks.select("tok").distinct().orderBy("tok").withColumn("_p", F.spark_partition_id())
    if folder:  # the ranges are drawn from a sample: written once, both uses below see the same ones
        ranged.write.mode("overwrite").parquet(folder)
        ranged = toks.sparkSession.read.parquet(folder)
    counts = ranged.groupBy("_p").count()
    starts = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return ranged.join(F.broadcast(starts), "_p").select("tok", (F.col("_s") + F.row_number().over(Window.partitionBy("_p").orderBy("tok")) - 1).alias("idx"))


def sparse_scores(queries: DataFrame, qid: str, posted: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """qid, key, score: sum of weights times IDF over a query's distinct tokens."""
    asked = tokens(queries, qid).distinct().join(idf.select("tok", "idf"), "tok")
    return posted.join(asked, "tok").groupBy(qid, key).agg(F.round(F.sum(F.col("w") * F.col("idf")), 9).alias("score"))


def dense_scores(queries: DataFrame, qid: str, vectors: DataFrame, key: str) -> DataFrame:
    """qid, key, score: dot products of unit vectors. Exact, so every query meets every vector: few queries go to the vectors, dealt over all tasks; top() keeps k a query in each task before anything is shuffled."""
    dealt = vectors.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.join(few(queries.select(qid, F.col("vec").alias("_q"))), F.lit(True)).select(qid, key, F.round(dot(F.col("vec"), F.col("_q")), 9).alias("score"))


def top(scored: DataFrame, qid: str, key: str, k: int = PREFETCH) -> DataFrame:
    """Adds rank (from 1) and keeps k a query; ties to the smaller key."""
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def fuse(branches: list[DataFrame], qid: str, key: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """qid, key, rank, score by reciprocal rank fusion of ranked branches; a query without a branch is fused from the rest."""
    every = branches[0].select(qid, key, "rank")
    for b in branches[1:]:
        every = every.unionByName(b.select(qid, key, "rank"))
    fused = every.groupBy(qid, key).agg(F.round(F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank"))), 9).alias("score"))
    return top(fused, qid, key, k)


def allowed(must: dict[str, list] | None = None, must_not: dict[str, list] | None = None) -> Column | None:
    """IN and null-safe NOT IN filters as one predicate; None without any."""
    found = None
    for terms, keep in ((must or {}, True), (must_not or {}, False)):
        for c, values in terms.items():
            if values:
                p = F.col(c).isin(values) if keep else ~F.coalesce(F.col(c).isin(values), F.lit(False))
                found = p if found is None else found & p
    return found


def exclusion_counts(baseline: DataFrame, qid: str, docs: DataFrame, key: str, excluded: Column) -> DataFrame:
    """qid, n_hits, n_excluded: how many hits of the search without opt-outs they would hide."""
    return baseline.join(docs, key).groupBy(qid).agg(F.count("*").alias("n_hits"), F.count(F.when(excluded, 1)).alias("n_excluded"))


def one_per_logical(hits: DataFrame, qid: str, logical: Column, k: int | None = None) -> DataFrame:
    """The best-ranked hit of each logical paragraph, and of these the first k."""
    best = hits.withColumn("logical", logical).withColumn("_r", F.row_number().over(Window.partitionBy(qid, "logical").orderBy("rank"))).where("_r = 1").drop("_r")
    return best if k is None else best.withColumn("_r", F.row_number().over(Window.partitionBy(qid).orderBy("rank"))).where(F.col("_r") <= k).drop("_r")


def context(targets: DataFrame, rows: DataFrame, scope: str, width: int) -> DataFrame:
    """Rows of the same scope within `width` of each target's seq: an equi-join on scope and offset, not a range join."""
    near = targets.select(scope, F.col("seq").alias("target_seq"), F.explode(F.sequence(F.col("seq") - width, F.col("seq") + width)).alias("seq"))
    return near.join(rows, [scope, "seq"]).withColumn("is_context", F.col("seq") != F.col("target_seq"))
