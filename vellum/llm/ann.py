"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Rows with one and the same vector are a class: the index holds classes, with their first few ids and how
often each is there, so a vector that a third of all rows share costs one entry. Centroids and codebooks are trained by k-means
on a bounded sample of unit vectors (at most `SAMPLE`) on the driver; every class is assigned to its
nearest centroid and its residual coded by one byte for each of `PARTS` parts. Beside the code stands its
error, the distance of what the code says from the residual.

A query class probes its `probes` nearest lists (7 in 10 of them unless told otherwise: vectors that
fill all directions alike, as those of the tests, need so many for a recall of 0.9 and more). Short lists
share a block, those longer than `BLOCK` are dealt over several. A task takes a block of codes and some
`ASKS` of the queries that probe it, builds each query's asymmetric
distance table (distances of its own residual to all codewords) and, by table look-ups, the coded
distance of every class in the probed lists. A class is at least its coded distance less its error away;
where that does not exclude it from the block's best, it is reranked exactly, however many they are:
cosine in double precision on the original vectors, ties to the smaller id. So the result is that of a
full comparison with the probed lists, and only lists not probed can cost recall.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id; rows that repeat an id count as candidates of their own. An asked
id that stands at several vectors finds each other row once, by the vector nearest to it. With fewer
candidates than asked for, all are returned. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch

SAMPLE, PARTS, WORDS, ROUNDS = 20_000, 16, 256, 8
#: Codes, and queries, that meet in one task.
BLOCK, ASKS = 2048, 1024
MAX_LISTS = 1024
#: What rounding may do to a distance of unit vectors (a root, so coarse near 0), and to a cosine.
SLACK_DISTANCE, SLACK_COSINE = 1e-6, 1e-11


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)] or [np.empty(0, np.intp)])


def kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from k distinct rows; an empty one moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        of = nearest(x, centres)
        many = np.bincount(of, minlength=len(centres))
        total = np.column_stack([np.bincount(of, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])])
        centres[many > 0] = total[many > 0] / many[many > 0][:, None]
        if (empty := np.flatnonzero(many == 0)).size:
            far = np.argsort(-((x - centres[of]) ** 2).sum(1), kind="stable")[: empty.size]
            centres[empty] = x[far]
    return centres


@dataclass
class Quantiser:
    coarse: np.ndarray  # lists x dimension
    words: list[np.ndarray]  # of each part: words x width
    cuts: np.ndarray  # where parts begin and end

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        coarse = kmeans(sample, min(lists, len(sample)))
        rest = sample - coarse[nearest(sample, coarse)]
        cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        return cls(coarse, [kmeans(rest[:, a:b], min(WORDS, len(rest))) for a, b in zip(cuts, cuts[1:])], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and the code's error of each row."""
        of = nearest(x, self.coarse)
        rest = x - self.coarse[of]
        codes = np.column_stack([nearest(rest[:, a:b], w) for a, b, w in zip(self.cuts, self.cuts[1:], self.words)]).astype(np.uint8)
        coded = np.column_stack([w[codes[:, j]] for j, w in enumerate(self.words)])
        return of, codes, np.sqrt(((rest - coded) ** 2).sum(1))

    def probes(self, x: np.ndarray, many: int) -> np.ndarray:
        return np.argsort(-(x @ self.coarse.T - (self.coarse**2).sum(1) / 2), 1, kind="stable")[:, :many]

    def distances(self, query: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to coded rows of list `of`, by its asymmetric distance table."""
        rest, total = query - self.coarse[of], np.zeros(len(codes))
        for j, (a, b, words) in enumerate(zip(self.cuts, self.cuts[1:], self.words)):
            total += ((words - rest[a:b]) ** 2).sum(1)[codes[:, j]]
        return total


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of x with y, or with those of y, added up in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total = total + x[:, j] * y[..., j]
    return total


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, vector (array of doubles) of the rows that take part."""
    rows = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (usual["d"] if usual else 0))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, probes: int = 0, lists: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: for each of `queries` (vec_id, which are ids of rows too) its k nearest others."""
    scratch = Scratch(rows.sparkSession, "ann")
    rows = valid(rows)
    first = Window.partitionBy("vector").orderBy("vec_id")
    members = rows.groupBy("vector", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("n")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    members = members.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("_m"))
    classes = members.select("vector", F.col("_m.vec_id").alias("ids"), F.col("_m.n").alias("counts")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch.write(classes, "classes")
    n = classes.count()
    lists = lists or int(min(MAX_LISTS, max(1, np.sqrt(n))))
    probes = probes or max(16, -(-lists * 7 // 10))
    share = min(1 << 30, (1 << 30) * SAMPLE // max(1, n))
    turn = F.xxhash64("vector")
    sample = classes.where(F.pmod(turn, F.lit(1 << 30)) < share).select("vector", turn.alias("turn")).orderBy("turn", "vector").limit(SAMPLE).toPandas()["vector"]  # in order, so that a rerun trains the same
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = rows.join(asked, "vec_id", "left_semi").join(classes, "vector").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).distinct()
    asked = scratch.write(asked, "asked")
    if not len(sample):
        near = classes.select(F.col("node").alias("query"), "node", F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score")).limit(0)
    else:
        near = candidates(classes, asked, Quantiser.fit(unit(np.array(sorted(map(list, sample)))), lists), probes, k + 1, scratch)
    same = Window.partitionBy("query", "vec_id")
    near = near.withColumn("_s", F.max("score").over(same)).withColumn("_r", F.row_number().over(same.orderBy(F.desc("score"), "node"))).where(F.col("_r") <= k)
    exact = near.withColumn("_r", F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("_s"), "vec_id"))).where(F.col("_r") <= k + 1)
    found = asked.join(exact, "query").where("vec_id <> query_id").groupBy("query_id", "node", "vec_id", "n").agg(F.max("score").alias("score"))
    found = found.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def candidates(classes: DataFrame, asked: DataFrame, model: Quantiser, probes: int, best: int, scratch: Scratch) -> DataFrame:
    """query, node, vec_id, n, score: of each block that a query class probes the `best` ids, exactly, in fewer than `best` classes each."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.array(f["vector"].tolist())
                of, codes, error = model.encode(unit(x))
                raw = lambda rows: [r.tobytes() for r in rows]
                yield pd.DataFrame({"list": of.astype(np.int32), "node": f["node"], "ids": f["ids"], "counts": f["counts"], "raw": raw(x), "code": raw(codes), "error": error})

    coded = scratch.write(classes.mapInPandas(encode, "list int, node long, ids array<long>, counts array<long>, raw binary, code binary, error double"), "coded")
    # lists go side by side into blocks of about BLOCK codes; a longer one has blocks of its own: list -> first block, blocks
    place, used, free = {}, 0, 0
    for r in coded.groupBy("list").count().orderBy("list").collect():  # at most MAX_LISTS rows
        if r["count"] > free:
            many = -(-r["count"] // BLOCK)
            place[r["list"]], used, free = (used, many), used + many, many * BLOCK - r["count"] if many == 1 else 0
        else:
            place[r["list"]], free = (used - 1, 1), free - r["count"]

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["vector"].tolist())
            hit: dict[tuple[int, int], list[int]] = {}
            for i, row in enumerate(model.probes(unit(x), probes) if len(f) else []):
                for of in row.tolist():
                    start, many = place.get(of, (0, 0))
                    for b in range(start, start + many):
                        hit.setdefault((b, i), []).append(of)
            yield pd.DataFrame([(b, f["node"].iloc[i], x[i].tobytes(), of) for (b, i), of in hit.items()], columns=["block", "query", "raw", "lists"])

    def scan(key: tuple, codes: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        codes = codes.sort_values(["list", "node"])
        lists, error, nodes, ids, counts = (codes[c].to_numpy() for c in ("list", "error", "node", "ids", "counts"))
        code = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), len(model.words))
        x = np.frombuffer(b"".join(codes["raw"])).reshape(len(codes), -1)
        units, lengths, lead = unit(x) if len(x) else x, np.sqrt(dots(x, x)), np.array([i[0] for i in ids])
        firsts, group = np.unique(lead, return_inverse=True)

        def limit(at: np.ndarray, v: np.ndarray) -> float:
            """What v is at most for the `best` classes with different first ids."""
            if len(firsts) < len(lead):
                least = np.full(len(firsts), np.inf)
                np.minimum.at(least, group[at], v)
                v = least
            return np.partition(v, best - 1)[best - 1] if len(v) >= best else np.inf

        out = []
        for query, raw, probed in zip(asks["query"], asks["raw"], asks["lists"]):
            q = np.frombuffer(raw)
            u = unit(q[None])[0]
            ranges = [(of, *np.searchsorted(lists, [of, of + 1])) for of in probed]
            at = np.concatenate([np.arange(a, b) for _, a, b in ranges])
            if len(at) > best:
                d = np.sqrt(np.concatenate([model.distances(u, of, code[a:b]) for of, a, b in ranges]))
                some = at[d <= limit(at, d)]
                farthest = np.sqrt(((units[some] - u) ** 2).sum(1)).max()
                at = at[d - error[at] <= farthest + SLACK_DISTANCE]
                cosine = (units @ u)[at] if 2 * len(at) > len(units) else units[at] @ u
                at = at[cosine >= -limit(at, -cosine) - SLACK_COSINE]
            score = dots(x[at], q) / np.sqrt(dots(q[None], q)) / lengths[at]
            who, many = np.concatenate(ids[at]), np.concatenate(counts[at])
            of = np.repeat(np.arange(len(at)), [len(i) for i in ids[at]])
            order = np.lexsort((who, -score[of]))
            which = pd.factorize(who[order])[0]
            order, which = order[which < best], which[which < best]
            if len(which) and which.max() + 1 < len(which):
                order = order[pd.Series(which).groupby(which).cumcount().to_numpy() < best - 1]
            out.append(pd.DataFrame({"query": query, "node": nodes[at][of[order]], "vec_id": who[order], "n": many[order], "score": score[of[order]]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.float64 if c == "score" else np.int64) for c in ("query", "node", "vec_id", "n", "score")})

    wanted = classes.join(asked.select(F.col("query").alias("node")).distinct(), "node", "left_semi").select("node", "vector")
    rounds = -(-wanted.count() // ASKS)
    asks = wanted.mapInPandas(probe, "block long, query long, raw binary, lists array<int>").withColumn("round", F.pmod(F.xxhash64("query"), F.lit(max(1, rounds))))
    spot = F.create_map(*(x for of, (start, many) in place.items() for x in (F.lit(of), F.lit((start << 32) | many).cast("long"))))[F.col("list")]
    dealt = coded.withColumn("_p", spot).withColumn("block", F.shiftright("_p", 32) + F.pmod(F.xxhash64("node"), F.col("_p").bitwiseAND(0xFFFFFFFF)))
    # a block stands once for each round of queries, so both sides of a group are bounded
    dealt = dealt.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, rounds) - 1).cast("long"))))
    return scratch.write(dealt.groupBy("block", "round").cogroup(asks.groupBy("block", "round")).applyInPandas(scan, "query long, node long, vec_id long, n long, score double"), "near")


def nearest_of_every_50th(rows: DataFrame, k: int = 5) -> DataFrame:
    return search(rows, rows.where(rows["vec_id"] % 50 == 0).select("vec_id"), k)
