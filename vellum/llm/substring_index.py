"""Substring dedup through a log-structured fingerprint index: all but the first occurrence of 20 words goes.

The log is a folder of immutable runs. A run holds the 64-bit rolling hash of every window that no
earlier run has, with the place of its first occurrence, sorted by hash: one row for each of `buckets`
ranges of the hash, its columns packed (sorted hashes as differences, bytes of like weight together), some
`RANGES` rows a file. Runs are bucketed tables, so they are never shuffled again.

1. A batch of documents is hashed where it is scanned. Windows that repeat within some million are told there, so
   that a passage of a third of all rows reaches its bucket once for each such stretch, not for each row.
2. The batch's windows are dealt to the buckets and merge-joined with the runs: what no run has and
   comes first in the batch is the next run; the rest are candidates, with the place they repeat.
3. Candidates go to their documents, where those that run on in both places become one stretch, told by
   the digest (128 bits, BLAKE2) of its words. Each is verified: the words at the place it repeats must
   have that digest (what goes round within a text is held against the text itself). Should two different windows share a hash, the stretch is tried window by window,
   and windows that only share the hash are settled among themselves by digest; the log keeps those.
4. With more than `max_runs` runs, all are compacted into one, bucket by bucket.

A log is opened again by its folder; a later batch is merged with the runs, and only the texts of that
batch and of the places it repeats are read. Batches come in the order of doc_id (a null one is the
greatest), so an earlier run never holds a later document. Order is by doc_id and place: rows that
repeat a doc_id do not precede each other at the same place.

Nulls: a null text has no words. Texts under 20 words lose nothing. Empty tables give empty results.
Very long texts are hashed a million windows at a time. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, sliced, text_or_empty, writing
from vellum.llm.repeats import C1, KEY, Units, covered, segments, spans, sums
from vellum.llm.suffix_dedup import gathered, keyed, with_spans

WORDS = Units("words", 20, 4, 4)
BATCHES, MAX_RUNS = 4, 2
#: Windows hashed at a time, windows of a bucket (about: its row stays well below a megabyte), buckets of a file, bytes of text in a group.
CHUNK, BUCKET, RANGES, GROUP = 1 << 20, 1 << 15, 32, 4 << 20
#: Rows of buckets that reach Python at once, groups of a partition.
AT_ONCE, GROUPS = 8, 4
#: What a word and the gap after it take at least, on average, in any text worth the name.
BYTES_PER_WORD = 6
HIT = pa.struct([("id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("id0", pa.int64()), ("start0", pa.int32())])
RUN = "bucket int, n long, hash binary, id binary, start binary, hits array<struct<id: long, start: int, windows: int, id0: long, start0: int>>"
REQUEST = "id long, text_hash long, start int, windows int, id0 long, start0 int, digest binary"


def pack(x: np.ndarray) -> bytes:
    """The bytes of a column, those of like weight together: the high ones are mostly zero and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def aligned(hits: list[np.ndarray]) -> list[np.ndarray]:
    """Joins hits (id, start, windows, id0, start0), sorted by id and start, that run on in both places."""
    i, s, n, i0, s0 = hits
    if not len(i):
        return hits
    end, end0 = s[:-1] + n[:-1], s0[:-1] + n[:-1]
    edge = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (i0[1:] != i0[:-1]) | (s[1:] != end) | (s0[1:] != end0)])
    return [i[edge], s[edge], np.add.reduceat(n, edge), i0[edge], s0[edge]]


def ordered(hits: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort((hits[1], hits[0]))
    return [x[order] for x in hits]


def hashed(units: Units, bits: int, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(id, first window, hashes) of the texts of a batch, some windows at a time."""
    low = np.uint64(64 - bits)
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        cut = units.split(text.as_py())
        for first, many in segments(len(cut), units.window):
            for a in range(first, first + many, CHUNK):
                b = min(first + many, a + CHUNK)
                u = units.hashes(cut[a : b + units.window - 1])
                s = np.arange(b - a)
                yield i, a, (spans(sums(u, C1), C1, s, s + units.window) >> low) << low


def windows(units: Units, buckets: int, bits: int):
    """(id, text) -> a row for each bucket of each chunk: its windows without repeats, and a share of the chunk's hits."""
    kinds = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("id", pa.binary()), ("start", pa.binary()), ("hits", pa.binary())])

    def flush(pieces: list) -> pa.RecordBatch:
        pieces.sort(key=lambda p: p[:2])
        h = np.concatenate([p[2] for p in pieces])
        many = [len(p[2]) for p in pieces]
        ids = np.repeat(np.array([p[0] for p in pieces], np.int64), many)
        start = np.concatenate([np.arange(p[1], p[1] + n, dtype=np.int32) for p, n in zip(pieces, many)])
        order = np.argsort(h, kind="stable")
        h, ids, start = h[order], ids[order], start[order]
        new = np.r_[True, h[1:] != h[:-1]]
        first = np.flatnonzero(new)
        source = first[np.cumsum(new) - 1]
        again = np.flatnonzero(~new & ((ids != ids[source]) | (start != start[source])))
        hits = aligned(ordered([ids[again], start[again].astype(np.int64), np.ones(len(again), np.int64), ids[source[again]], start[source[again]].astype(np.int64)]))
        hits = np.column_stack(hits)
        h, ids, start = h[first], ids[first], start[first]
        of = bucket_of(h, buckets)
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        cuts = list(zip(edge, np.append(edge[1:], len(of))))
        shares = np.array_split(hits, len(cuts))
        return pa.record_batch(
            [pa.array(of[edge].astype(np.int32)), [pack_sorted(h[a:b]) for a, b in cuts], [pack(ids[a:b]) for a, b in cuts], [pack(start[a:b]) for a, b in cuts], [pack_rows(x) for x in shares]], schema=kinds
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in batches:
            for piece in hashed(units, bits, batch):
                pieces.append(piece)
                size += len(piece[2])
                if size >= CHUNK:
                    yield flush(pieces)
                    pieces, size = [], 0
        if size:
            yield flush(pieces)

    return run


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def pack_rows(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).reshape(-1, 5).view(np.uint8).reshape(len(x), 40).T.tobytes()


def unpack_rows(raw: bytes) -> list[np.ndarray]:
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(40, -1).T).view(np.int64)
    return [x[:, k] for k in range(5)]


def merged(runs: int):
    """(bucket, parts, hash and id and start of each run) -> RUN: what is new in a bucket, and the rest as hits."""

    def one(parts: list[dict], old: list[tuple]) -> tuple:
        h = np.concatenate([unpack_sorted(p["hash"]) for p in parts])
        ids, start = (np.concatenate([unpack(p[c], k) for p in parts]) for c, k in (("id", np.int64), ("start", np.int32)))
        order = np.argsort(h, kind="stable")
        h, ids, start = h[order], ids[order], start[order]
        new = np.r_[True, h[1:] != h[:-1]]
        some = np.flatnonzero(~new | ~np.r_[new[1:], True])  # of hashes that stand twice or more, by id and start
        order = some[np.lexsort((start[some], ids[some], h[some]))]
        ids[some], start[some] = ids[order], start[order]
        first = np.flatnonzero(new)
        i0, s0, fresh = ids[first].copy(), start[first].copy(), np.ones(len(first), bool)
        for run_h, run_id, run_start in old:
            if run_h:
                there = unpack_sorted(run_h)
                at = np.minimum(np.searchsorted(there, h[first]), len(there) - 1)
                same = np.flatnonzero(there[at] == h[first])
                i0[same], s0[same], fresh[same] = unpack(run_id, np.int64)[at[same]], unpack(run_start, np.int32)[at[same]], False
        group = np.cumsum(new) - 1
        again = np.flatnonzero((ids != i0[group]) | (start != s0[group]))
        of = group[again]
        hits = [ids[again], start[again].astype(np.int64), np.ones(len(again), np.int64), i0[of], s0[of].astype(np.int64)]
        told = [unpack_rows(p["hits"]) for p in parts]
        hits = aligned(ordered([np.concatenate([x, *(t[k] for t in told)]) for k, x in enumerate(hits)]))
        keep = first[fresh]
        return len(keep), pack_sorted(h[keep]), pack(ids[keep]), pack(start[keep]), hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = [batch.column(k)[r].as_py() for k in range(2 + 3 * runs)]
                n, *packed, hits = one(row[1], [tuple(row[2 + 3 * k : 5 + 3 * k]) for k in range(runs)])
                struct = pa.StructArray.from_arrays([pa.array(x.astype(k.type.to_pandas_dtype())) for x, k in zip(hits, HIT)], fields=list(HIT))
                yield pa.record_batch([pa.array([row[0]], pa.int32()), pa.array([n]), *(pa.array([x], pa.binary()) for x in packed), pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)], ["bucket", "n", "hash", "id", "start", "hits"])

    return run


def compacted(runs: int):
    """(bucket, hash and id and start of each run) -> RUN without hits; no hash stands in two runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = [batch.column(k)[r].as_py() for k in range(1 + 3 * runs)]
                there = [row[1 + 3 * k : 4 + 3 * k] for k in range(runs) if row[1 + 3 * k] is not None]
                if not there:
                    continue
                h = np.concatenate([unpack_sorted(t[0]) for t in there])
                order = np.argsort(h, kind="stable")
                ids, start = (np.concatenate([unpack(t[k], kind) for t in there])[order] for k, kind in ((1, np.int64), (2, np.int32)))
                none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], HIT))
                yield pa.record_batch([pa.array([row[0]], pa.int32()), pa.array([len(h)]), *(pa.array([x], pa.binary()) for x in (pack_sorted(h[order]), pack(ids), pack(start))), none], ["bucket", "n", "hash", "id", "start", "hits"])

    return run


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def stretches(units: Units, apart: bool):
    """(group, id, text_hash, text), (group, HIT) -> REQUEST: hits joined as far as they run on; one by one if `apart`, or where rows share an id.

    A window that names the same place as an earlier one of its own text is held against that one, here and
    now; found equal it repeats it, and stands in a row without a place. So what goes round in a text asks once.
    """
    names = [c.split()[0] for c in REQUEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    width = units.window

    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        found = ordered([np.asarray(hits.column(c).combine_chunks()).astype(np.int64) for c in ("id", "start", "windows", "id0", "start0")])
        ids = texts.column("id").to_pylist()
        twice = {i for i, n in zip(*np.unique(np.array(ids, np.int64), return_counts=True)) if n > 1}
        rows = []
        for i, text_hash, text in zip(ids, texts.column("text_hash").to_pylist(), texts.column("text")):
            lo, hi = np.searchsorted(found[0], i), np.searchsorted(found[0], i, "right")
            if lo == hi:
                continue
            words = units.split(text.as_py())
            many = found[2][lo:hi]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start, i0, s0 = (np.repeat(found[k][lo:hi], many) for k in (1, 3, 4))
            start, s0 = start + step, s0 + step
            start, i0, s0 = np.unique(np.column_stack([start, i0, s0])[start + width <= len(words)], axis=0).T  # rows that repeat an id and text give a hit each
            if not apart:
                order = np.lexsort((start, s0, i0))
                first = np.r_[True, (np.diff(i0[order]) != 0) | (np.diff(s0[order]) != 0)][: len(order)]
                earlier = np.empty(len(order), np.int64)
                earlier[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
                again = np.flatnonzero(earlier != np.arange(len(order)))
                equal = again[[words[a : a + width] == words[b : b + width] for a, b in zip(start[again].tolist(), start[earlier[again]].tolist())]] if len(again) else again
                if len(equal):
                    s = np.sort(start[equal])
                    edge = np.flatnonzero(np.r_[True, np.diff(s) > 1])
                    rows += [(i, text_hash, a, n, None, None, None) for a, n in zip(s[edge].tolist(), np.diff(np.append(edge, len(s))).tolist())]
                    rest = np.ones(len(start), bool)
                    rest[equal] = False
                    start, i0, s0 = start[rest], i0[rest], s0[rest]
            own = [np.full(len(start), i), start, np.ones(len(start), np.int64), i0, s0]
            for _, s, n, a, b in zip(*(x.tolist() for x in (own if apart or i in twice else aligned(own)))):
                rows.append((i, text_hash, s, n, a, b, digest(words[s : s + n + width - 1])))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return run


def verify(units: Units):
    """(group, id, text_hash, text), (group, id0, start0, windows, digest) -> those that the text bears out."""

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.select(["id0", "start0", "windows", "digest"]).combine_chunks().sort_by("id0")
        ids = np.asarray(asked.column("id0").combine_chunks())
        start, many, wanted = (asked.column(c).to_pylist() for c in ("start0", "windows", "digest"))
        there = np.zeros(len(ids), bool)
        for i, text in zip(texts.column("id").to_pylist(), texts.column("text")):
            lo, hi = np.searchsorted(ids, i), np.searchsorted(ids, i, "right")
            if lo < hi:
                words = units.split(text.as_py())
                for k in range(lo, hi):
                    there[k] |= start[k] + many[k] + units.window - 1 <= len(words) and digest(words[start[k] : start[k] + many[k] + units.window - 1]) == wanted[k]
        return asked.filter(pa.array(there))

    return run


class FingerprintIndex:
    """The log in `path`: created for about `buckets` times BUCKET windows, or opened again as it is."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, max_runs: int = MAX_RUNS, units: Units = WORDS, bits: int = 64):
        self.spark, self.path, self.units, self.max_runs = spark, path.rstrip("/"), units, max_runs
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.runs, self.buckets, self.bits, self.tables = 0, [], buckets, bits, {}
        known = [s.getPath().getName() for s in self._files.listStatus(self._path(self.path))] if self._files.exists(self._path(self.path)) else []
        if known := sorted(int(k.split("-")[1]) for k in known if k.startswith("manifest-") and self._files.exists(self._path(f"{self.path}/{k}/_SUCCESS"))):
            state = json.loads(spark.read.text(f"{self.path}/manifest-{known[-1]}").first()[0])
            self.version, self.runs, self.buckets, self.bits = known[-1], state["runs"], state["buckets"], state["bits"]

    @property
    def files(self) -> int:
        return -(-self.buckets // RANGES)

    def _commit(self, runs: list[str]) -> None:
        """The next manifest; only then are runs that it does not name deleted."""
        state = json.dumps({"runs": runs, "buckets": self.buckets, "bits": self.bits})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version + 1}")
        for name in set(self.runs) - set(runs):
            self._files.delete(self._path(f"{self.path}/{name}"), True)
            self.spark.sql(f"drop table if exists {self.tables.pop(name)}")
        self.version, self.runs = self.version + 1, runs

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        table = self.tables[name] = f"vellum_{name.replace('-', '_')}"
        with writing(self.spark, AT_ONCE):
            rows.write.format("parquet").option("path", f"{self.path}/{name}").option("compression", "zstd").bucketBy(self.files, "bucket").sortBy("bucket").saveAsTable(table)
        return name

    def table(self, name: str) -> DataFrame:
        """A run as a table bucketed by hash range."""
        if name not in self.tables:
            table = self.tables[name] = f"vellum_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {table} ({RUN}) using parquet clustered by (bucket) sorted by (bucket) into {self.files} buckets location '{self.path}/{name}'")
        return self.spark.table(self.tables[name])

    def _joined(self, rows: DataFrame) -> DataFrame:
        """A row a bucket, and beside it what each run has there: all are dealt alike, so no run moves."""
        for k, name in enumerate(self.runs):
            run = self.table(name).select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("hash", "id", "start")))
            rows = rows.hint("merge").join(run.hint("merge"), "bucket", "left")
        return rows

    def add(self, docs: DataFrame) -> DataFrame:
        """Merge-joins a batch of documents with the runs, appends what is new, and gives the candidates: HIT rows."""
        texts = keyed(docs).select("id", "text")
        parts = texts.mapInArrow(windows(self.units, self.buckets, self.bits), "bucket int, hash binary, id binary, start binary, hits binary")
        parts = parts.repartition(self.files, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("hash", "id", "start", "hits")).alias("parts"))
        rows = self._joined(parts)
        name = self._write(rows.mapInArrow(merged(len(self.runs)), RUN))
        self._commit([*self.runs, name])
        return self.table(name).select(F.explode("hits").alias("h")).select("h.*")

    def compact_if_many(self) -> None:
        """One run of all. Candidates of these runs are to be read before."""
        if len(self.runs) > self.max_runs:
            every = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
            rows = self._joined(every.repartition(self.files, "bucket"))
            self._commit([self._write(rows.mapInArrow(compacted(len(self.runs)), RUN))])

    def _grouped(self, rows: DataFrame, key: str, groups: int) -> DataFrame:
        """Rows with their group, dealt to partitions of a few groups, however much there is."""
        return rows.withColumn("group", F.pmod(F.xxhash64(key), F.lit(groups))).repartition(-(-groups // GROUPS), "group")

    def discard(self) -> None:
        """Deletes the log, as one that served a single call."""
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self._files.delete(self._path(self.path), True)
        self.runs, self.tables = [], {}

    def requests(self, docs: DataFrame, hits: DataFrame, groups: int, apart: bool = False) -> DataFrame:
        left, right = self._grouped(keyed(docs), "id", groups), self._grouped(hits, "id", groups)
        return left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(stretches(self.units, apart), REQUEST)

    def borne_out(self, corpus: DataFrame, requests: DataFrame, groups: int) -> DataFrame:
        """id0, start0, windows, digest: the requests that the words at the place they name bear out."""
        asked = requests.select("id0", "start0", "windows", "digest").distinct()
        texts = keyed(corpus).join(requests.select(F.col("id0").alias("id")).distinct(), "id", "left_semi")
        return self._grouped(texts, "id", groups).groupBy("group").cogroup(self._grouped(asked, "id0", groups).groupBy("group")).applyInArrow(verify(self.units), "id0 long, start0 int, windows int, digest binary")

    def repeats(self, docs: DataFrame, hits: DataFrame, corpus: DataFrame, scratch: Scratch, groups: int) -> DataFrame:
        """KEY, start, end of the words of docs that repeat. corpus: the texts of all batches so far, of which those that candidates name are read."""
        return self.settled(docs, scratch.write(self.requests(docs, hits, groups), f"asked-{self.version}"), corpus, scratch, groups)

    def settled(self, docs: DataFrame, told: DataFrame, corpus: DataFrame, scratch: Scratch, groups: int) -> DataFrame:
        """KEY, start, end of requests (of one batch, or of several at once) that hold."""
        key = ["id0", "start0", "windows", "digest"]
        here, asked = told.where("id0 is null").select(*KEY, "start", "windows"), told.where("id0 is not null")
        good = scratch.write(self.borne_out(corpus, asked, groups), f"good-{self.version}")
        sure, doubt = asked.join(good, key, "left_semi"), asked.join(good, key, "left_anti")
        side = f"{self.path}/collisions"
        if not doubt.isEmpty():
            alone = scratch.write(self.requests(docs, doubt.select("id", "start", "windows", "id0", "start0").distinct(), groups, apart=True), f"alone-{self.version}")
            good = scratch.write(self.borne_out(corpus, alone, groups), f"good-alone-{self.version}")
            sure = sure.select(*KEY, "start", "windows").unionByName(alone.join(good, key, "left_semi").select(*KEY, "start", "windows"))
            left = scratch.write(alone.join(good, key, "left_anti").select(*KEY, "start", "windows", "digest"), f"left-{self.version}")
            firsts = left.select("digest", "id", "start")
            if self._files.exists(self._path(side)):
                firsts = firsts.unionByName(self.spark.read.parquet(side))
            firsts = firsts.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("first"))
            later = left.join(firsts, "digest").where((F.col("id") > F.col("first.id")) | ((F.col("id") == F.col("first.id")) & (F.col("start") > F.col("first.start"))))
            sure = sure.unionByName(scratch.write(later.select(*KEY, "start", "windows"), f"later-{self.version}"))
            left.select("digest", "id", "start").write.mode("append").parquet(side)
        sure = sure.select(*KEY, "start", "windows").unionByName(here)
        return sure.select(*KEY, "start", (F.col("start") + F.col("windows") + (self.units.window - 1)).alias("end"))


def batches_of(docs: DataFrame, many: int) -> list[DataFrame]:
    """Ranges of doc_id; the last has the rows without one."""
    x = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if x["lo"] is None or many < 2:
        return [docs]
    edges = [x["lo"] + (x["hi"] - x["lo"]) * k // many for k in range(1, many)]
    where = [docs["doc_id"] < edges[0]] + [(docs["doc_id"] >= a) & (docs["doc_id"] < b) for a, b in zip(edges, edges[1:])]
    return [docs.where(w) for w in where] + [docs.where((docs["doc_id"] >= edges[-1]) | docs["doc_id"].isNull())]


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, starts, ends) -> doc_id, n_words, n_removed, kept_sha256."""
    for batch in sliced(batches):
        rows = []
        for text, starts, ends in zip(*(batch.column(k) for k in (1, 2, 3))):
            words = kept = text.as_py().split()
            if starts.is_valid:
                mask = covered(len(words), starts.as_py(), ends.as_py())
                kept = [w for w, gone in zip(words, mask) if not gone]
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, gone, hexes = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(hexes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, batches: int = BATCHES, max_runs: int = MAX_RUNS, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row of docs. Builds a log over all of docs in some batches."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substring-index")
    size = docs.agg(F.sum(F.octet_length(text_or_empty(docs)))).first()[0] or 0
    index = FingerprintIndex(spark, f"{scratch.root}/log", size // BYTES_PER_WORD // BUCKET + 1, max_runs, bits=bits)
    groups, hits = size // GROUP + 1, None
    for number, batch in enumerate(batches_of(docs, batches)):
        part = scratch.write(index.add(batch), f"hits-{number}")
        hits = part if hits is None else hits.unionByName(part)
        index.compact_if_many()
    index.discard()  # this call's alone; what the candidates name is in docs
    found = index.repeats(docs, hits, docs, scratch, groups)
    spans_ = scratch.write(gathered(found.distinct()), "spans")
    rows = with_spans(docs, spans_).select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).cast("binary").alias("text"), spans_["starts"], spans_["ends"])
    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
