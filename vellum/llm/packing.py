"""Best-fit packing: bounded-space online best-fit over token sequences of a fixed capacity.

Every document becomes its ids and an end id; what is longer than the capacity is cut into full pieces
and a rest. Full pieces are sequences of their own and meet no bin. The others are packed by one pass, the
longest first: at most `open_bins` bins are open, a piece goes to the open bin with the least free space
that holds it, and if none does a new bin opens; beyond the bound the fullest closes first. Open bins are
found by a bitset keyed by free space, so a step takes a few integer operations.

Packing needs lengths only, so texts stay in the scan: it writes narrow rows, which are then dealt by a hash
of their key to packers of about `PIECES_PER_PACKER` pieces. Any one packer leaves at most its open bins unfilled.
A task that runs again gets the same pieces in the same order, so it gives the same sequences.

Nulls: a null text is an empty document (its end id alone); a null doc_id is kept. Repeated rows are
packed as often as they stand. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, sliced

CAPACITY, END_ID = 2048, 0
OPEN_BINS = 4096
PIECES_PER_PACKER = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID):
    """An Arrow function from (doc_id, text) to one row for each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vellum.llm.tokenizing import word_ids

        encode, end = word_ids(tokenizer).ids, int(end_id).to_bytes(4, "little")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                ids = memoryview(encode(text.as_py() or b"") + end)
                n = len(ids) // 4
                rows += [(doc_id.as_py(), k, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * min(n, at + capacity)])) for k, at in enumerate(range(0, n, capacity))]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


class BestFit:
    """Bounded-space online best-fit: bins are numbered from `first`."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.room, self.next = capacity, open_bins, first
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset there of a piece of 1 to capacity tokens. One that fills a bin leaves the open ones alone."""
        if length == self.capacity:
            self.next += 1
            return self.next - 1, 0
        if fits := self.free >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.room:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            free, number, self.next = self.capacity, self.next, self.next + 1
        if left := free - length:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free &= ~(1 << free)
        self.open -= 1
        return number


def place(capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
    """A pandas function that adds sequence_id and offset to the pieces of a partition."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fit = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for frame in frames:
            got = np.array([fit.put(n) for n in frame["length"].tolist()], np.int64).reshape(-1, 2)
            frame["sequence_id"], frame["offset"] = got[:, 0], got[:, 1]
            yield frame

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, pieces_per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    pieces = Scratch(docs.sparkSession, "packing").write(narrow.mapInArrow(pieces_of(tokenizer, capacity, end_id), PIECES), "pieces")
    packers = max(1, -(-pieces.count() // pieces_per_packer))
    dealt = pieces.repartition(packers, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    return dealt.mapInPandas(place(capacity, open_bins), f"{PIECES}, sequence_id long, offset long")
