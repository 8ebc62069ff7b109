"""A content fingerprint of ordered texts, SHA-256 of texts joined by NUL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_group(rows: DataFrame, by: str, order: str, text: str, first: str | None = None) -> DataFrame:
    """by, fingerprint (16 hex digits). Texts stream through one digest a group in order, so no group is held; nulls are left out.

    `first`, where given, stands before all texts, as the name of a model does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, begun = None, None, False

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([group], batch.schema.field(0).type), pa.array([digest.hexdigest()[:16]])], [by, "fingerprint"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest is None or key != group:
                    if digest is not None:
                        yield done()
                    group, digest, begun = key, hashlib.sha256((first or "").encode()), first is not None
                if value is not None:
                    digest.update((b"\0" if begun else b"") + value.encode())
                    begun = True
        if digest is not None:
            yield done()

    ordered = rows.select(by, order, text).repartition(by).sortWithinPartitions(by, order, text)
    return ordered.mapInArrow(run, f"{by} {rows.schema[by].dataType.simpleString()}, fingerprint string")


# ---- which rows changed


def hash_tree(rows: DataFrame, key: str, text: str, levels: int = 3, width: int = 4) -> DataFrame:
    """level, node, digest, n: a tree of digests over rows with distinct keys; one text among them changes its leaf and the nodes above, to the root (level 0, node '').

    A leaf (level `levels` + 1) is a key with the SHA-256 of its text (a null is not an empty one). The others are ranges of the keys' hashes, `width` times as
    many bits at each level, and their digest is that of their members' in order. Inner nodes are small at any size of the corpus: a node of the deepest range holds
    rows / 2 ** (levels * width) leaves, so choose levels by the number of rows. Texts are read once, for the leaves.
    """
    place = F.sha2(F.col(key).cast("string"), 256)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    leaf = F.sha2(F.concat_ws("\0", F.col(key).cast("string"), F.col(text).isNull().cast("string"), F.col(text)), 256)
    digits = max(1, width // 4)
    below = rows.select(F.lit(levels + 1).alias("level"), name.alias("node"), F.substring(place, 1, levels * digits).alias("up"), leaf.alias("digest"), F.lit(1).cast("long").alias("n"))
    tree = below.select("level", "node", "digest", "n")
    for level in range(levels, -1, -1):
        members = F.array_sort(F.collect_list(F.struct("node", "digest")))
        joined = F.array_join(F.transform(members, lambda m: F.concat(m["node"], F.lit("\0"), m["digest"])), "\0")
        below = below.groupBy("up").agg(F.sha2(joined, 256).alias("digest"), F.sum("n").alias("n"))
        below = below.select(F.lit(level).alias("level"), F.col("up").alias("node"), F.substring("up", 1, max(0, (level - 1) * digits)).alias("up"), "digest", "n")
        tree = tree.unionByName(below.select("level", "node", "digest", "n"))
    return tree


def write_tree(rows: DataFrame, path: str, key: str, text: str, levels: int = 3, width: int = 4) -> DataFrame:
    """The tree in a folder, by level: a comparison reads the levels that it needs."""
    hash_tree(rows, key, text, levels, width).withColumn("range", F.when(F.col("level") == levels + 1, F.substring(F.sha2("node", 256), 1, levels * max(1, width // 4)))).write.mode("overwrite").partitionBy("level").parquet(path)
    return rows.sparkSession.read.parquet(path)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change (added, removed, changed) between two trees of one shape, as write_tree left them. Roots first: equal ones end it, and leaves are read of the ranges that differ alone."""
    leaves = before.agg(F.max("level")).first()[0] or after.agg(F.max("level")).first()[0] or 0
    differ = lambda a, b, on: a.join(b, on, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    side = lambda t, level, name: t.where(F.col("level") == level).select("node", "range", F.col("digest").alias(name))
    same_root = differ(side(before, 0, "_a").drop("range"), side(after, 0, "_b").drop("range"), "node").isEmpty()
    ranges = differ(side(before, leaves - 1, "_a").drop("range"), side(after, leaves - 1, "_b").drop("range"), "node").select(F.col("node").alias("range"))
    of = lambda t, name: side(t, leaves, name).where(F.lit(not same_root)).join(ranges, "range", "left_semi").drop("range")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return differ(of(before, "_a"), of(after, "_b"), "node").select(F.col("node").alias("key"), change.alias("change"))
