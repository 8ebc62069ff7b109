"""SuperMinHash near-duplicates: signatures, banding, exact verification, union-find.

1. A document's set is its distinct shingles of `k` words (A-Z in lower case), as 64-bit hashes; with
   fewer words the whole sequence is one shingle, and without words the set is empty and linked with
   nothing. Documents with the same set are one class, told by a 128-bit hash.
2. Each class gets a SuperMinHash signature (Ertl, 2017): step j gives every element a random number
   in [j, j + 1) for one slot, which walks through a random permutation of the slots, so the slots'
   ranks are correlated and the variance is lower; it stops as soon as all slots are filled.
3. Slots are cut into bands; classes that share a band share a bucket. With 32 bands of 4 slots a pair
   of similarity 0.85 is missed with a probability below 1e-10, one of 0.8 below 1e-7.
4. In each bucket every class is paired with one member only, another for each bucket, so pairs grow
   linearly. Pairs are confirmed on full sets, and components are found by alternating stars.
5. In buckets of more than `LARGE` (four blocks) that still hold several components, one member of each component is paired
   with one of the largest, another each round, as long as that finds links (at most `ROUNDS` times); this
   too grows linearly, and joins what one unlucky hub kept apart.
6. Buckets of three or more that are mixed even then are worked off exactly, in blocks: a task takes two blocks of a bucket, finds all numbers of shared shingles as products of 0-1 matrices,
   and returns only links that join components, as a union-find tells.

Texts are shuffled once, to give the candidates their sets. Copies never meet in one task: they are
classes from the first aggregate on, and come back by a join on the class that splits hot ones.

Nulls: a null text is empty; a null doc_id is kept, takes the component of its class (the least id
there) and is never the one kept unless its class has no id at all. Repeated rows fall into one class;
rows that repeat a doc_id are kept or not together. Empty tables give empty results. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, sliced, text_or_empty
from vellum.llm.components import components

SLOTS, BANDS = 128, 32
BLOCK, LARGE, ROUNDS = 512, 2048, 4
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    if not width:
        return hashes
    found = mix64(hashes[: len(hashes) - width + 1] + np.uint64(width))
    for j in range(1, width):
        found = mix64(found * P1 + hashes[j : len(hashes) - width + 1 + j])
    return np.unique(found)


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Of distinct 64-bit hashes: for each slot the step (from bit 32 up) and 32 random bits."""
    n, rows = len(elements), np.arange(len(elements))
    none = np.uint64(1 << 63)
    found, walk = np.full(slots, none, np.uint64), None
    for j in range(slots):
        x = mix64(elements + np.uint64((j + 1) * int(P1) % (1 << 64)))
        at = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.intp)
        if j == 0:
            slot, first = at, at
        else:
            if walk is None:
                walk = np.tile(np.arange(slots, dtype=np.uint8), (n, 1))
                walk[rows, first], walk[:, 0] = 0, first
            slot = walk[rows, at].astype(np.intp)
            walk[rows, at] = walk[:, j]
        np.minimum.at(found, slot, (x >> np.uint64(32)) | np.uint64(j << 32))
        if found.max() != none:
            break
    return found


def bands_of(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts, keys = found.reshape(bands, -1), np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(parts.shape[1]):
        keys = mix64(keys * P1 + parts[:, j])
    return keys.view(np.int64)


def signed(k: int, slots: int = SLOTS, bands: int = BANDS):
    """(doc_id, text_key, text) -> what SIGNED says; rows without words have a null set_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches):
            keys, sizes, cells = [], [], []
            for text in batch.column(2):
                elements = shingle_set(text.as_py() or b"", k)
                sizes.append(len(elements))
                if len(elements):
                    s = signature(elements, slots)
                    keys.append(xxhash.xxh3_128_digest(elements.tobytes()))
                    cells.append(bands_of(s, bands))
                else:
                    keys.append(None), cells.append(None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], ["doc_id", "text_key", "set_key", "n", "bands"])

    return run


SIGNED = "doc_id long, text_key binary, set_key binary, n long, bands array<long>"


def sets(k: int):
    """(node, text) -> (node, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.record_batch([batch.column(0), pa.array([shingle_set(t.as_py() or b"", k).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "items"])

    return run


def alike(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * both >= percent * (a + b - both)


def shared(items: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """The exact number of items that each row of `left` shares with each of `right`, by products of 0-1 matrices some columns at a time."""
    flat, of = np.concatenate(items), np.repeat(np.arange(len(items)), [len(x) for x in items])
    _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
    often = many > 1
    at, of = (np.cumsum(often) - 1)[at[often[at]]], of[often[at]]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    found = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, int(often.sum()), columns):
        lo, hi = np.searchsorted(at, [start, start + columns])
        x = np.zeros((len(items), columns), np.float32)
        x[of[lo:hi], at[lo:hi] - start] = 1
        found += x[left] @ x[right].T
    return found


def settle(percent: int):
    """The exact work on two blocks of a bucket: links (a, b) that join components."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part, node, size, component = (rows[c].to_numpy() for c in ("part", "node", "n", "component"))
        left, right = (np.flatnonzero(part == key[i]) for i in (1, 2))
        linked = alike(shared(list(rows["items"]), left, right), size[left][:, None], size[right][None, :], percent)
        linked &= component[left][:, None] != component[right][None, :]
        parent = {c: c for c in component}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links = []
        for i in np.flatnonzero(linked.any(1)):
            js = right[linked[i]]
            for j in js[np.unique(component[js], return_index=True)[1]]:
                a, b = find(component[left[i]]), find(component[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((node[left[i]], node[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def with_component(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """cell, many, node, n, component of the buckets (cell, many, node, n of all members) that hold several components; of buckets with the same members one."""
    left = with_component(members, found)
    mixed = left.groupBy("cell").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.count("*").alias("many"))
    mixed = mixed.where("c0 <> c1").groupBy("who", "many").agg(F.min("cell").alias("cell"))
    return left.join(mixed.select("cell"), "cell", "left_semi").select("cell", "many", "node", "n", "component")


def between(left: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b): in each bucket one member of every component, another each turn, beside one of the largest component."""
    pick = F.min(F.struct(F.xxhash64(F.lit(turn), "cell", "node").alias("t"), "node", "n")).alias("pick")
    picks = left.groupBy("cell", "component").agg(pick, F.count("*").alias("size"))
    hubs = picks.groupBy("cell").agg(F.max(F.struct("size", "component", "pick")).alias("hub"))
    near = picks.join(hubs, "cell").where("component <> hub.component").select(F.col("pick.node").alias("x"), F.col("pick.n").alias("n"), F.col("hub.pick.node").alias("y"), F.col("hub.pick.n").alias("m"))
    return near.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, slots: int = SLOTS, bands: int = BANDS, large: int = LARGE) -> DataFrame:
    """doc_id, text_key (MD5), n_shingles, component_id, kept: a row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(text_or_empty(docs))).alias("text_key"), text_or_empty(docs).cast("binary").alias("text"))
    rows = scratch.write(keyed.mapInArrow(signed(k, slots, bands), SIGNED), "signed")
    # the row that stands for a class: its least id (null last), then its least text
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_key"))
    classes = rows.where("set_key is not null").groupBy("set_key").agg(first.alias("first"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    cells = classes.select(F.explode("bands").alias("cell"), "node", "n")
    hub = F.min(F.struct(F.xxhash64("cell", "node").alias("turn"), "node", "n")).alias("hub")
    ends = scratch.write(cells.groupBy("cell").agg(hub, F.count("*").alias("many")).where("many > 1"), "cells")
    near = cells.join(ends, "cell").where("node <> hub.node").where(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    pairs = scratch.write(near.select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")).distinct(), "pairs")

    # buckets of three or more may need the exact work below, so their members get sets as well
    members = cells.join(ends.where("many > 2"), "cell", "left_semi").select("node")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members).distinct()
    source = classes.join(wanted, "node").select("node", F.col("first.id").alias("_id"), F.col("first.text_key").alias("_key"))
    texts = keyed.withColumn("_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumnRenamed("text_key", "_key")
    items = scratch.write(texts.join(source, ["_id", "_key"]).select("node", "text").mapInArrow(sets(k), "node long, items array<long>").dropDuplicates(["node"]), "items")
    items_of = lambda side: items.select(F.col("node").alias(side), F.col("items").alias(f"items_{side}"))
    both = F.size(F.array_intersect("items_a", "items_b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return pairs.join(items_of("a"), "a").join(items_of("b"), "b").where(alike(both, F.size("items_a"), F.size("items_b"), percent)).select("a", "b")

    sure = scratch.write(confirmed(pairs), "links")
    found = scratch.write(components(sure, scratch, "graph"), "found")
    left = scratch.write(mixed_buckets(cells.join(ends.where("many > 2").select("cell", "many"), "cell"), found), "mixed")
    for turn in range(ROUNDS):
        pairs = scratch.write(between(left.where(F.col("many") > large), turn, percent), f"pairs-{turn}")
        if pairs.isEmpty():
            break
        more = scratch.write(confirmed(pairs), f"links-{turn}")
        if more.isEmpty():
            break
        sure = sure.unionByName(more)
        found = scratch.write(components(sure, scratch, f"graph-{turn}"), f"found-{turn}")
        left = scratch.write(mixed_buckets(left.drop("component"), found), f"mixed-{turn}")  # only what was mixed can be

    left = left.withColumn("parts", F.ceil(F.col("many") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    left = left.join(items, "node")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "component", "n", "items")
    more = left.groupBy("cell", "p", "q").applyInPandas(settle(percent), "a long, b long")
    more = scratch.write(more.distinct(), "more")
    if not more.isEmpty():
        found = scratch.write(components(sure.unionByName(more), scratch, "again"), "found-again")

    named = with_component(classes.select("node", "set_key", "least_id"), found)
    named = named.join(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").select("set_key", "component_id")
    named = scratch.write(named, "named")
    out = rows.select("doc_id", "text_key", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, unchanged: what goes is found first, as narrow rows."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    gone = Scratch(docs.sparkSession, "keep-one").write(gone, "gone")
    key = F.unhex(F.md5(text_or_empty(docs)))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (key == gone["_key"]), "left_anti")
