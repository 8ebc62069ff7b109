"""Conversation prefix tries, family first.

Conversations of one base id are a family: each is rebuilt from the first turns of the base and its own later ones.
Families share most of their prefixes within themselves, so each builds its own small trie where its conversations meet
its base's first turns (a cogroup), and only family nodes, already combined, are shuffled to merge with other families'.

Turns leave their texts behind in the scan: what goes on is a digest of role and text and the text's length. A node is known by its depth
and 128 bits that are a sum over its path: of each turn, hashed with its place. Such sums can be taken in
any order, so a conversation of any length can be dealt to many tasks; that two of a billion nodes meet has odds below 1e-19.

What a node needs of its whole subtree is summed without walking the merged trie. Of saved tokens, what the members say
is a sum over members, which families have; what the distinct nodes say, and which of them are leaves, counts in the one family that holds
a node's smallest member, once merging has shown which that is. So there are two merges, whatever the depth.

Conversations of more than `long_turns` turns when rebuilt take no part in a family's group: they are chains of their own, numbered and summed
in ranges of (conversation, turn) with what stands before each range added, and meet the others in the same merges. A family's group is
then at most its ids (199 in the query) times `long_turns` narrow rows. Prefixes that many families share are merged by partial sums; the ids that end at a node
stream through one digest in order, a row for each family, as a SHA-256 of all of them is asked for.

Order of turns: by turn, null first; ties by the digest of role and text. Null role or text is empty. Rows without a conv_id are
no conversation. Repeated rows are turns of their own. Ids may be negative (their base is towards zero). An empty table gives an empty one.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch

FAMILY, MOST_SHARED, LONG_TURNS = 100, 6, 2_000
NODE = ["depth", "a", "b"]
LANE = 0xFFFFFFFF
FAMILY_NODES = "family long, no long, parent long, depth long, a long, b long, n_convs long, first long, inner boolean, size long, gross long, ends string"
SUMS = "depth long, a long, b long, sizes long, leaves long, children long, conv_id long, parent_conv_id long"


# ---- nodes by the sum of their turns' digests


def lanes_of(place: Column, turn: Column) -> list[Column]:
    """Four whole numbers of 32 bits for a turn at its place."""
    mixed = F.md5(F.concat(place.cast("string"), F.lit(":"), turn).cast("binary"))
    return [F.conv(F.substring(mixed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"l{k}") for k in range(4)]


def packed(*lanes: Column) -> list[Column]:
    """Sums of lanes as the two halves of a node's id."""
    low = [x.bitwiseAND(F.lit(LANE)) for x in lanes]
    return [F.shiftleft(low[k], 32).bitwiseOR(low[k + 1]).alias(name) for k, name in ((0, "a"), (2, "b"))]


def _lanes(places: Iterator[int], turns: Iterator[str]) -> np.ndarray:
    joined = b"".join(hashlib.md5(b"%d:%s" % (p, t.encode())).digest() for p, t in zip(places, turns))
    return np.frombuffer(joined, ">u4").reshape(-1, 4).astype(np.int64)


def _packed(lanes: np.ndarray) -> np.ndarray:
    low = lanes & LANE
    return (low[:, ::2] << 32) | low[:, 1::2]


# ---- families


def _family(key: tuple, own: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    """The trie of one family: own has a row for each turn of its conversations, heads the base's first turns."""
    heads = heads.sort_values("place", kind="stable")
    own = own.sort_values(["conv", "has_turn", "turn", "digest"], kind="stable")
    head = list(zip(heads["digest"], heads["size"]))
    nodes: dict[tuple, list] = {(0, 0, 0): [0, -1, 0, 0]}  # (depth, a, b): its number, its parent's, members so far, size
    paths, ends = [], {}
    head_lanes = _lanes(range(len(head)), (d for d, _ in head)) if head else np.zeros((0, 4), np.int64)
    for conv, rows in own.groupby("conv", sort=True):
        shared = min(int(rows["shared"].iloc[0]), len(head))
        kept = rows.iloc[int(rows["shared"].iloc[0]) :]
        lanes = head_lanes[:shared]
        if len(kept):
            lanes = np.concatenate([lanes, _lanes(range(shared, shared + len(kept)), kept["digest"])])
        ids = _packed(lanes.cumsum(axis=0)).tolist()
        sizes = [s for _, s in head[:shared]] + kept["size"].tolist()
        path, above = [0], 0
        for depth, ((a, b), size) in enumerate(zip(ids, sizes), 1):
            at = nodes.setdefault((depth, a, b), [len(nodes), above, 0, size])
            path.append(above := at[0])
        paths.append((int(conv), path))
        ends.setdefault(above, []).append(str(conv))
    n = len(nodes)
    parent, size = (np.fromiter((v[k] for v in nodes.values()), np.int64, n) for k in (1, 3))
    n_convs, gross, first = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    for conv, path in paths:
        n_convs[path] += 1
        gross[path] += size[path][::-1].cumsum()[::-1]
        first[path] = np.minimum(first[path], conv)
    inner = np.zeros(n, bool)
    inner[parent[1:]] = True
    ids = np.array(list(nodes), np.int64).reshape(-1, 3)
    return pd.DataFrame({"family": key[0], "no": np.arange(n), "parent": parent, "depth": ids[:, 0], "a": ids[:, 1], "b": ids[:, 2], "n_convs": n_convs, "first": first, "inner": inner, "size": size, "gross": gross, "ends": [",".join(ends[k]) if k in ends else None for k in range(n)]})


def _own_sums(nodes: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of a family's trie of what is the family's own: of the nodes whose smallest member it holds."""
    nodes = nodes.sort_values("no", kind="stable")
    parent, n = nodes["parent"].to_numpy(), len(nodes)
    own = (nodes["first"] == nodes["conv_id"]).to_numpy()
    sizes, leaves, children = np.where(own, nodes["size"], 0), (own & ~nodes["has_children"].to_numpy()).astype(np.int64), np.zeros(n, np.int64)
    depth = nodes["depth"].to_numpy()
    by_depth = np.split(np.argsort(-depth, kind="stable"), np.cumsum(np.bincount(depth)[::-1])[:-1])
    for level in by_depth[:-1]:
        np.add.at(sizes, parent[level], sizes[level])
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(children, parent[level], own[level])
    ids = nodes["conv_id"].astype("Int64").reset_index(drop=True)
    above = ids.take(np.maximum(parent, 0)).reset_index(drop=True).where(pd.Series(own & (parent >= 0)))
    return pd.DataFrame({"depth": depth, "a": nodes["a"].to_numpy(), "b": nodes["b"].to_numpy(), "sizes": sizes, "leaves": leaves, "children": children, "conv_id": ids.where(pd.Series(own)), "parent_conv_id": above})


# ---- long conversations


def running(rows: DataFrame, conv: str, order: list[str], sums: dict[str, Column], scratch: Scratch, name: str, parts: int) -> DataFrame:
    """Adds running sums (this row's included) within conv, in order. Ranges of (conv, order) are summed apart, then what stands before each is added, so no conversation meets in one task."""
    ranged = rows.withColumns({f"_{c}": x for c, x in sums.items()}).repartitionByRange(parts, conv, *order).sortWithinPartitions(conv, *order)
    ranged = scratch.write(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    totals = ranged.groupBy(conv, "_part").agg(*(F.sum(f"_{c}").alias(f"_t_{c}") for c in sums))
    before = Window.partitionBy(conv).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(conv, "_part", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy(conv, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_i_{c}": F.sum(f"_{c}").over(inside) for c in sums}).join(totals, [conv, "_part"])
    return summed.withColumns({c: F.col(f"_i_{c}") + F.col(f"_b_{c}") for c in sums}).select(*rows.columns, *sums)


def _chains(turns: DataFrame, heads: DataFrame, long: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """conv, depth, a, b, size, total, gross, above_a, above_b: the nodes of each long conversation, its root too. total: the conversation's last depth."""
    own = running(turns.join(long, "conv"), "conv", ["turn", "digest"], {"place": F.lit(1)}, scratch, "long-places", parts)
    own = own.where(F.col("place") > F.col("shared")).select("conv", "taken", "total", (F.col("place") - F.col("shared") + F.col("taken")).alias("depth"), "digest", "size")
    base = long.join(heads.withColumnRenamed("conv", "family"), "family").where(F.col("place") < F.col("taken")).select("conv", "taken", "total", (F.col("place") + 1).alias("depth"), "digest", "size")
    rows = own.unionByName(base).select("conv", "depth", "size", "total", *lanes_of(F.col("depth") - 1, F.col("digest")))
    sums = {f"s{k}": F.col(f"l{k}") for k in range(4)} | {"said": F.col("size")}
    rows = scratch.write(running(rows, "conv", ["depth"], sums, scratch, "long-sums", parts), "long")
    said = rows.where(F.col("depth") == F.col("total")).select("conv", F.col("said").alias("all"))
    s = [F.col(f"s{k}") for k in range(4)]
    above = [x.alias(f"above_{x_name}") for x, x_name in zip(packed(*(x - F.col(f"l{k}") for k, x in enumerate(s))), "ab")]
    nodes = rows.join(said, "conv").select("conv", "depth", *packed(*s), "size", "total", (F.col("all") - F.col("said") + F.col("size")).alias("gross"), *above)
    zero = F.lit(0).cast("long")
    roots = said.join(long.select("conv", "total"), "conv").select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("size"), "total", F.col("all").alias("gross"), zero.alias("above_a"), zero.alias("above_b"))
    return scratch.write(nodes.unionByName(roots), "chains")


def _chain_nodes(chains: DataFrame) -> DataFrame:
    """As a family of one; the deepest node is where it ends."""
    inner = F.col("depth") < F.col("total")
    return chains.select(F.col("conv").alias("family"), *NODE, F.lit(1).cast("long").alias("n_convs"), F.col("conv").alias("first"), inner.alias("inner"), "size", "gross", F.when(~inner, F.col("conv").cast("string")).alias("ends"))


def _chain_sums(chains: DataFrame, merged: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """As _own_sums, for long conversations."""
    rows = chains.join(merged.select(*NODE, "conv_id", "has_children"), NODE).withColumns({"back": -F.col("depth"), "own": F.col("conv") == F.col("conv_id")})
    sums = {"sizes": F.when(F.col("own"), F.col("size")).otherwise(0), "leaves": (F.col("own") & ~F.col("has_children")).cast("long")}
    rows = scratch.write(running(rows, "conv", ["back"], sums, scratch, "long-back", parts), "long-own")
    above = merged.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("conv_id").alias("parent_conv_id"))
    zero, one, owned = F.lit(0).cast("long"), F.lit(1).cast("long"), lambda c: F.when(F.col("own"), F.col(c)).alias(c)
    rows = rows.join(above, ["depth", "above_a", "above_b"], "left")
    nodes = rows.select(*NODE, "sizes", "leaves", zero.alias("children"), owned("conv_id"), owned("parent_conv_id"))
    parents = rows.where(F.col("own") & (F.col("depth") > 0)).select((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"), F.col("above_b").alias("b"), zero.alias("sizes"), zero.alias("leaves"), one.alias("children"))
    return nodes.unionByName(parents, allowMissingColumns=True)


# ---- the whole


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One SHA-256 for each node over its rows, which come together and in order."""
    last, running_digest = None, None
    for frame in frames:
        out = []
        for *node, ends in frame[[*NODE, "ends"]].itertuples(index=False):
            if node != last:
                if last:
                    out.append((*last, running_digest.hexdigest()))
                last, running_digest = node, hashlib.sha256(ends.encode())
            else:
                running_digest.update(b"," + ends.encode())
        yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
    if last:
        yield pd.DataFrame([(*last, running_digest.hexdigest())], columns=[*NODE, "ends_sha256"])


def prefix_trie(conversations: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED, long_turns: int = LONG_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node; conv_id and depth name it."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.char_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"))
    turns = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].cast("long").alias("turn"), digest.alias("digest"), F.char_length(text("text")).cast("long").alias("size"))
    turns = scratch.write(turns, "turns")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    order = Window.partitionBy("conv").orderBy("turn", "digest")
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % most_shared
    heads = turns.where(F.col("conv") % family == 0).withColumn("nth", F.row_number().over(order)).where(F.col("nth") < most_shared)  # Spark limits before it shuffles
    heads = scratch.write(heads.select("conv", (F.col("nth") - 1).cast("long").alias("place"), "digest", "size"), "heads")
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    there = heads.groupBy(F.col("conv").alias("family")).agg(F.count("*").alias("there"))
    convs = convs.withColumns({"family": F.col("conv") - F.col("conv") % family, "shared": shared}).join(there, "family", "left")
    convs = convs.withColumn("taken", F.least("shared", F.coalesce("there", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0)))
    long = scratch.write(convs.where(F.col("total") > long_turns).select("conv", "family", "shared", "taken", "total"), "long-convs")

    own = turns.join(long, "conv", "left_anti").select((F.col("conv") - F.col("conv") % family).alias("family"), "conv", shared.alias("shared"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), "digest", "size")
    by_family = own.groupBy("family").cogroup(heads.withColumnRenamed("conv", "family").groupBy("family"))
    tries = scratch.write(by_family.applyInPandas(lambda key, own, heads: _family(key, own, heads) if len(own) else pd.DataFrame([], columns=[c.split()[0] for c in FAMILY_NODES.split(", ")]), FAMILY_NODES), "tries")
    chains = None if long.isEmpty() else _chains(turns, heads, long, scratch, parts)
    every = tries if chains is None else tries.unionByName(_chain_nodes(chains), allowMissingColumns=True)
    merged = every.groupBy(*NODE).agg(F.sum("n_convs").alias("n_convs"), F.min("first").alias("conv_id"), F.max("inner").alias("has_children"), F.sum("gross").alias("gross"))
    merged = scratch.write(merged, "merged")
    sums = tries.join(merged.select(*NODE, "conv_id", "has_children"), NODE).groupBy("family").applyInPandas(_own_sums, SUMS)
    sums = sums if chains is None else sums.unionByName(_chain_sums(chains, merged, scratch, parts))
    sums = sums.groupBy(*NODE).agg(F.sum("sizes").alias("sizes"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"), F.max("parent_conv_id").alias("parent_conv_id"))
    ends = every.where(F.col("ends").isNotNull()).select(*NODE, "family", "ends").repartition(*NODE).sortWithinPartitions(*NODE, "family")
    digests = ends.mapInPandas(_digests, "depth long, a long, b long, ends_sha256 string")
    found = merged.join(sums, NODE).join(digests, NODE, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("gross") - F.col("sizes")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
