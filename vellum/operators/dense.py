"""The dense index: vectors by the sign pattern of random projections, probed in order, filtered inside, reranked exactly.

A vector's code is the signs of its projections on `bits` random directions. A query visits the codes in order of how far it is from their
sides (the sum of its squared projections over the signs that differ), its own first, and holds its vector against those of the codes that it visits: an
equi-join on code, not every query with every vector. The columns in `by` lie beside the vectors, so a filter on them is
applied as a code is read, before anything is scored or ranked.

How many codes are visited is measured when the index is built: for some of its vectors the true neighbours are looked up, and where
they stand in the order. A filter that leaves one in s of the vectors makes the best k as far as the best k * s of all, so the numbers of visits are kept by
depth. Vectors that fill all directions alike need most codes, clustered ones few; a query's best 50 are found with a recall of `RECALL` at least, up to chance.

Codes that hold more than `SLICE` vectors are cut into slices, and a query's visit to one becomes a visit to each.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import dot
from vellum.operators import search

PER_CODE, MOST_BITS, SLICE, FOLDERS = 32, 14, 20_000, 64
SAMPLE, RECALL, SEED = 48, 0.97, 7
DEPTHS = [50, 200, 1000, 5000]


def directions(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits))


def codes_of(projected: np.ndarray) -> np.ndarray:
    return (projected > 0) @ (1 << np.arange(projected.shape[1]))


def order_of_codes(projected: np.ndarray, bits: int) -> np.ndarray:
    """For each query all codes, nearest first."""
    differs = (np.arange(1 << bits)[:, None] >> np.arange(bits) & 1)[None] != (projected > 0)[:, None]
    return np.argsort((differs * projected[:, None] ** 2).sum(2), axis=1, kind="stable")


def _matrix(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), np.float64).reshape(len(s), -1)


class DenseIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = json.loads(spark.read.text(f"{self.path}/manifest").first()[0])

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(self.manifest["schema"])).parquet(f"{self.path}/vectors")

    def visits(self, k: int, share: float = 1.0) -> int:
        """How many codes a query for the best k visits where a filter leaves `share` of the vectors."""
        m, depth = self.manifest, k / max(share, 1e-9)
        enough = [v for d, v in zip(m["depths"], m["visits"]) if d >= depth]
        return enough[0] if enough else 1 << m["bits"]

    def top(self, asked: DataFrame, qid: str, k: int = search.PREFETCH, where: Column | None = None) -> DataFrame:
        """asked: qid, vec -> qid, key, score, rank of the best k found. where: a filter on the columns in `by`."""
        m = self.manifest
        sizes = self.spark.read.parquet(f"{self.path}/sizes")
        share = 1.0
        if where is not None and m["n"]:
            share = (sizes.where(where).agg(F.sum("n")).first()[0] or 0) / m["n"]
        n, bits, planes = self.visits(k, share), m["bits"], directions(m["dim"], m["bits"])

        def visited(s: pd.Series) -> pd.Series:
            return pd.Series([x for part in np.array_split(np.arange(len(s)), max(1, len(s) << bits >> 20)) if len(part) for x in order_of_codes(_matrix(s.iloc[part]) @ planes, bits)[:, :n].tolist()], dtype=object)

        run = F.pandas_udf(visited, "array<int>")
        slices = sizes.groupBy("code").agg(F.max("slices").alias("slices"))
        visits = asked.select(qid, F.col("vec").alias("_q"), F.explode(run("vec")).alias("code")).join(slices, "code")
        visits = visits.select(qid, "_q", "code", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        vectors = self.vectors if where is None else self.vectors.where(where)
        met = vectors.select(m["key"], "vec", "code", "slice").join(visits, ["code", "slice"])
        return search.top(met.select(qid, m["key"], F.round(dot(F.col("vec"), F.col("_q")), 9).alias("score")), qid, m["key"], k)


def build(vectors: DataFrame, path: str, key: str, by: list[str] = (), bits: int | None = None, recall: float = RECALL) -> DenseIndex:
    """vectors: key, vec (unit vectors of one length), and the columns in `by`. Vectors that are null take no part."""
    spark, path, by = vectors.sparkSession, path.rstrip("/"), list(by)
    rows = vectors.where("vec is not null").select(key, "vec", *by)
    first = rows.select(F.size("vec"), F.lit(0)).first()
    dim, n = (first[0] if first else 1), rows.count()
    bits = bits or int(np.clip(np.round(np.log2(max(n, 1) / PER_CODE)), 1, MOST_BITS))
    planes = directions(dim, bits)
    code = F.pandas_udf(lambda s: pd.Series(codes_of(_matrix(s) @ planes).astype(np.int32)), "int")
    coded = rows.withColumn("code", code("vec"))
    counts = coded.groupBy("code").agg(F.count("*").alias("n"))
    coded.write.mode("overwrite").parquet(f"{path}/coded")
    coded = spark.read.parquet(f"{path}/coded")
    slices = coded.groupBy("code").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    cut = coded.join(slices, "code").withColumn("slice", F.pmod(F.xxhash64(key), F.col("slices")).cast("int")).withColumn("folder", F.col("code") % FOLDERS)
    schema = T.StructType([f for f in cut.schema if f.name != "folder"])
    cut.repartition("folder", "code", "slice").sortWithinPartitions("folder", "code", *by).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/vectors")
    kept = spark.read.schema(schema).parquet(f"{path}/vectors")
    kept.groupBy("code", *by).agg(F.count("*").alias("n"), F.max("slices").alias("slices")).write.mode("overwrite").parquet(f"{path}/sizes")
    depths, visits = _calibrated(kept, key, n, bits, planes, recall)
    manifest = json.dumps({"key": key, "by": by, "dim": dim, "bits": bits, "n": n, "depths": depths, "visits": visits, "schema": schema.jsonValue()})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return DenseIndex(spark, path)


def _calibrated(vectors: DataFrame, key: str, n: int, bits: int, planes: np.ndarray, recall: float) -> tuple[list[int], list[int]]:
    """For each depth the number of visits that reaches `recall` of the best so many of SAMPLE vectors, the first by a hash of their key."""
    some = vectors.select(F.xxhash64(key).alias("turn"), key, "vec").orderBy("turn", key).limit(SAMPLE).select("vec").collect()
    if not some:
        return [], []
    queries = np.array([r.vec for r in some], np.float64)
    depths = [d for d in DEPTHS if d <= n] or [n]
    asked = vectors.sparkSession.createDataFrame([(i, r.vec) for i, r in enumerate(some)], "q int, _q array<double>")
    score = dot(F.col("vec"), F.col("_q"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), key))
    best = vectors.join(F.broadcast(asked)).select("q", key, "code", score.alias("s")).withColumn("r", rank).where(F.col("r") <= depths[-1]).select("q", "r", "code").collect()
    place = np.argsort(order_of_codes(queries @ planes, bits), axis=1)
    found = np.array([(r.r, place[r.q, r.code]) for r in best])
    visits = [int(np.sort(found[found[:, 0] <= d, 1])[min(int(np.ceil(recall * (found[:, 0] <= d).sum())), (found[:, 0] <= d).sum()) - 1]) + 1 for d in depths]
    return depths, visits
