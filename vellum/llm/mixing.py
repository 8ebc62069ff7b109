"""Mixing sources to target weights by nested hash thresholds, in DataFrame functions only.

Sizes are words. The sources, by code point and null last, weigh `WEIGHTS` in turn and share `BUDGET`
times all words; a target stops at `MAX_REPEATS` times its source's size, and what it cannot take is
shared again by weight. A source takes all its documents floor(target / size) times, and once more
those whose hash lies below the source's threshold; so a larger budget always takes a superset.

Thresholds come from histograms, never from a sort of documents: words are summed by source and the
top bits of a document's hash, the bucket that the budget falls into is found by running sums over
buckets, and only its documents are summed again by the next bits, until the hash is used up. In the
last bucket, which holds documents with one and the same hash, the nearer end is taken. The hash is
of the whole row's key (doc_id, source, text), so repeated rows go together.

Nulls: a null text has size 0, a null source is a source of its own, a null doc_id is kept. Documents
of size 0 are taken or not without effect. Empty tables give empty results. Other columns pass through
`mix` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import GAP, Scratch, quoted, text_or_empty

#: Fixed values of the production mix.
WEIGHTS, BUDGET, MAX_REPEATS = (3, 1, 2), 1.5, 2
#: A hash has LEVELS * BITS bits; each level has a histogram of 2 ** BITS buckets a source.
BITS, LEVELS = 10, 6


def size_of(docs: DataFrame) -> Column:
    text = text_or_empty(docs)
    return F.size(F.array_remove(F.split(text, GAP), "")).cast("long")


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds mix_rank, from 0: the place of a source by code point, null last. Numbers are given in sorted partitions and offset by the counts of those before."""
    order = [F.col("mix_source").isNull(), F.col("mix_source")]
    placed = scratch.write(sources.orderBy(*order).withColumn("_part", F.spark_partition_id()), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return placed.join(starts, "_part").select(*sources.columns, (F.col("_start") + F.row_number().over(inside) - 1).alias("mix_rank"))


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: float = MAX_REPEATS) -> DataFrame:
    """Adds mix_target to (mix_source, mix_source_size, mix_rank): weight times one level, or the cap. Each round brings one row of sums to the driver, until no source newly passes its cap."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("mix_rank") % len(weights) + 1).cast("int"))
    cap = F.col("mix_source_size") * float(repeats)
    level, total = 0.0, None
    while True:
        full = weight * level >= cap
        x = sources.agg(F.sum("mix_source_size").alias("all"), F.sum(F.when(full, cap)).alias("caps"), F.sum(F.when(~full, weight)).alias("weights")).first()
        if total is None:
            total = budget * (x["all"] or 0)
        if not x["weights"] or (risen := (total - (x["caps"] or 0.0)) / x["weights"]) <= level * (1 + 1e-15):
            break
        level = risen
    return sources.withColumn("mix_target", F.least(weight * level, cap))


def thresholds(rows: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """mix_source, mix_source_size, mix_target, mix_base (whole repeats), mix_below: hashes below it are taken once more."""
    whole = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("mix_base", whole).withColumn("_left", F.col("mix_target") - F.col("mix_base") * F.col("mix_source_size")).withColumn("mix_below", F.lit(0).cast("long"))
    state = scratch.write(state.drop("mix_rank"), "state")
    found, inside = state, rows
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("mix_hash", shift)
        sums = inside.groupBy("mix_source", bucket.alias("_bucket")).agg(F.sum("mix_size").alias("_sum"), F.count("*").alias("_rows"))
        run = Window.partitionBy("mix_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0)))
        joined = sums.join(found.select(F.col("mix_source").alias("_of"), "_left"), F.col("mix_source").eqNullSafe(F.col("_of")))
        # the bucket that the budget falls into: the first whose running sum passes it
        edge = scratch.write(joined.where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_sum") > F.col("_left"))).select("_of", "_bucket", "_before", "_sum", "_rows"), f"edge{level}")
        last = level == LEVELS - 1
        here = F.shiftleft(F.col("_bucket"), shift)
        if last:  # one hash: the nearer end
            here = here + F.when(2 * (F.col("_left") - F.col("_before")) >= F.col("_sum"), F.lit(1)).otherwise(F.lit(0))
        found = found.join(edge, F.col("mix_source").eqNullSafe(F.col("_of")), "left").select(
            "mix_source", "mix_source_size", "mix_target", "mix_base", (F.col("_left") - F.coalesce("_before", F.lit(0))).alias("_left"), F.coalesce(here, F.lit(0)).alias("mix_below")
        )
        found = scratch.write(found, f"found{level}")
        if last or edge.where("_rows > 1").isEmpty():
            # single documents in the edge bucket: the nearer end, by the whole bucket
            if not last:
                up = edge.join(found.select(F.col("mix_source").alias("_s"), F.col("_left").alias("_l")), F.col("_of").eqNullSafe(F.col("_s"))).select(
                    "_of", F.when(2 * F.col("_l") >= F.col("_sum"), F.lit(1 << shift)).otherwise(F.lit(0)).alias("_up")
                )
                found = found.join(up, F.col("mix_source").eqNullSafe(F.col("_of")), "left").withColumn("mix_below", F.col("mix_below") + F.coalesce("_up", F.lit(0))).drop("_of", "_up")
                found = scratch.write(found, "found")
            break
        cut = edge.select(F.col("_of"), F.col("_bucket").alias("_edge"))
        inside = scratch.write(inside.join(cut, F.col("mix_source").eqNullSafe(F.col("_of")) & (bucket == F.col("_edge")), "left_semi"), f"inside{level}")
    return found.drop("_left")


def keyed(docs: DataFrame, seed: str) -> DataFrame:
    """Adds mix_source, mix_hash and mix_size."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs["doc_id"], docs["source"], docs["text"]), 64 - BITS * LEVELS)
    return docs.withColumns({"mix_source": docs["source"].cast("string"), "mix_hash": key, "mix_size": size_of(docs)})


def plan(docs: DataFrame, weights: tuple, budget: float, repeats: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id and what keyed() adds), and the sources with what they take."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.write(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "mix_source", "mix_hash", "mix_size"), "rows")
    sources = scratch.write(rows.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size")), "sources")
    targets = scratch.write(with_targets(scratch.write(ranked(sources, scratch), "ranked"), weights, budget, repeats), "targets")
    return rows, thresholds(rows, targets, scratch).withColumnRenamed("mix_source", "_of")


def taken(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds mix_source_size, mix_target and mix_copies to keyed rows. Few sources are broadcast by their size; many are joined, and a hot one is split by the engine."""
    rows = rows.join(found, F.col("mix_source").eqNullSafe(F.col("_of")), "left")
    return rows.withColumn("mix_copies", F.col("mix_base") + (F.col("mix_hash") < F.col("mix_below")).cast("long")).drop("_of", "mix_source", "mix_hash", "mix_base", "mix_below")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: float = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mix: the rows of docs, each as often as it is taken."""
    _, found = plan(docs, weights, budget, repeats, seed)
    row = F.struct(*(docs[quoted(c)].alias(c) for c in docs.columns)).alias("mix_row")
    rows = taken(keyed(docs.select("doc_id", "source", "text", row), seed), found)
    return rows.select("mix_row", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int")))).select(*(F.col("mix_row").getField(c).alias(c) for c in docs.columns))


def mix_report(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: float = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row of docs."""
    return taken(*plan(docs, weights, budget, repeats, seed)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    )
