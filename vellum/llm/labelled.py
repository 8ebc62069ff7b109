"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sample are no longer than so many bytes; scoring has no such bound.
SAMPLE_BYTES = 65_536
BUCKETS = 1 << 30


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is remainder; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def share_of(doc_id: Column, wanted: int, there: int, seed: str) -> Column:
    """True for about `wanted` of `there` ids, by their hash."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(BUCKETS)) < min(BUCKETS, BUCKETS * wanted // max(1, there))


def sample_class(docs: DataFrame, labels: DataFrame, column: str, value: int, rows: int, seed: str) -> list[tuple[int, bytes]]:
    """Up to `rows` (doc_id, text as UTF-8) whose label is `value`, to the driver: at most rows * SAMPLE_BYTES bytes.

    The ids that the labels give are at most about `rows`, so they are broadcast and no text is shuffled.
    """
    ids = labels.where((F.col(column) == value) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.where(share_of(F.col("doc_id"), rows, ids.count(), seed)).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    return sample_rows(docs.join(F.broadcast(ids), docs["doc_id"].cast("long") == ids["doc_id"], "left_semi"), rows, seed)


def sample_rows(docs: DataFrame, rows: int, seed: str) -> list[tuple[int, bytes]]:
    """The first `rows` by a hash of their id, then by one of their text, so that a rerun learns from the same. Which they are is found among narrow rows; only their texts leave the scan."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string").cast("binary")
    turn = F.struct(F.xxhash64(F.lit(seed), doc_id).alias("turn"), doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    short = docs.where((F.octet_length(text) <= SAMPLE_BYTES) & doc_id.isNotNull())
    first = short.select(turn.alias("t")).orderBy("t").limit(rows).select("t.*").collect()
    if not first:
        return []
    last = F.struct(*(F.lit(first[-1][c]).cast("long").alias(c) for c in ("turn", "doc_id", "text_hash")))
    found = short.where(turn <= last).select(doc_id.alias("doc_id"), text.alias("text")).collect()
    return sorted((x["doc_id"], bytes(x["text"])) for x in found)[:rows]


def sample_unlabelled(docs: DataFrame, rows: int, seed: str) -> list[tuple[int, bytes]]:
    """Up to `rows` of any documents with an id, by its hash."""
    return sample_rows(docs.where(docs["doc_id"].isNotNull() & share_of(docs["doc_id"].cast("long"), rows, docs.count(), seed)), rows, seed)
