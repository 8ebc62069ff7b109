"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens): `tokenizer` is the SHA-256 of the
library's name, its version and the vocabulary file; `digest` is the SHA-256 of the normalised content.
Normalising here means null to the empty text and UTF-8, nothing more: any folding of case, spaces or
Unicode would change counts. Texts are first reduced to the distinct ones, in each task before they
are shuffled, then joined to the cache; only distinct misses are encoded and appended. Documents then
take their counts by digest, as narrow rows.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is kept. Repeated rows each give
a row. An empty table gives an empty result. Very long texts are encoded whole. Other columns are not
read. Rows of the cache written twice by jobs side by side do no harm: they are reduced when read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import text_or_empty

LIMIT = 4096
CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(f"sentencepiece {sentencepiece.__version__} ".encode() + f.read()).hexdigest()


def encode(path: str):
    """An Arrow function from (digest, text) to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vellum.llm.tokenizing import piece_counts

        count = piece_counts(path).count
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([count(x.as_py()) for x in batch.column(1).cast(pa.binary())], pa.int64())], ["digest", "n_tokens"])

    return run


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """digest, n_tokens of one tokenizer; None if nothing has been stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each row of docs. Appends what it had to encode to `cache`."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    text = text_or_empty(docs)
    distinct = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if (known := cached(spark, cache, version)) is not None:
        distinct = distinct.join(known.select("digest"), "digest", "left_anti")
    encoded = distinct.mapInArrow(encode(path), "digest binary, n_tokens long")
    encoded.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.join(cached(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
