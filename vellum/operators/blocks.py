"""Blocks of postings from rows of tokens that lie together by range, in Arrow batches.

Rows come with a document's place (range, slot), length and key beside each token, in order of range: a range is done when the next one begins, so a task holds
the tokens of `ROWS` rows or `BYTES` and of one range, and a range with more than that as counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, BYTES = 1 << 19, 1 << 26
SLICE = 256  # tokens a row


def sliced(rows: DataFrame) -> DataFrame:
    """Rows with an array `toks`, as several where it is long, in order."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("toks"), F.lit(1)), F.lit(SLICE))  # a filter on the size would be pushed to where texts are read, and cut them there too
    return rows.withColumn("toks", F.explode(F.transform(starts, lambda i: F.slice("toks", i, F.lit(SLICE)))))


def flat(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row for each token, where rows have arrays of them."""
    if "toks" not in batch.schema.names:
        yield batch
        return
    for start in range(0, batch.num_rows, ROWS // SLICE):
        part = batch.slice(start, ROWS // SLICE)
        toks = part.column("toks")
        rows = pa.array(np.repeat(np.arange(part.num_rows), np.diff(toks.offsets.to_numpy())))
        yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:-1]), toks.flatten()], [*part.schema.names[:-1], "tok"])


def counted(rows: pa.Table, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens; by document in order of place, its place as a number and a row that has it; by posting in order of token and place, its token, document and count."""
    no = rows["range"].to_numpy() * width + rows["slot"].to_numpy()
    heads = np.flatnonzero(np.r_[True, no[1:] != no[:-1]])
    places, first, of = np.unique(no[heads], return_index=True, return_inverse=True)
    toks = rows["tok"].combine_chunks().dictionary_encode(null_encoding="encode")
    both = toks.indices.to_numpy().astype(np.int64) * len(places) + np.repeat(of, np.diff(np.r_[heads, len(no)]))
    if "tf" in rows.column_names:
        order = np.argsort(both, kind="stable")
        both, tf = both[order], rows["tf"].to_numpy()[order]
    else:
        both.sort()
        tf = None
    starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    tf = np.diff(np.r_[starts, len(both)]) if tf is None else np.add.reduceat(tf, starts)
    return toks.dictionary, places, heads[first], both[starts] // len(places), both[starts] % len(places), tf


def summed(rows: pa.Table, width: int, key: str) -> pa.Table:
    """The same with a row for each document and token, and its count as tf."""
    words, places, at, code, doc, tf = counted(rows, width)
    row = at[doc]
    return pa.table({"range": places[doc] // width, "slot": pa.array(places[doc] % width, pa.int32()), "dl": rows["dl"].to_numpy()[row], key: rows[key].combine_chunks().take(pa.array(row)), "tok": words.take(pa.array(code)), "tf": tf})


def blocks_of(rows: pa.Table, width: int, key: str) -> pa.RecordBatch:
    """A row for each range and token. rows: whole ranges."""
    words, places, at, code, doc, tf = counted(rows, width)
    at_range, slot, dl = places[doc] // width, places[doc] % width, rows["dl"].to_numpy()[at][doc]
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at_range[1:] != at_range[:-1])])
    ends = np.r_[starts, len(code)]
    entries = pa.StructArray.from_arrays([rows[key].combine_chunks().take(pa.array(at)).take(pa.array(doc)), pa.array(tf), pa.array(dl), pa.array(slot, pa.int32())], [key, "tf", "dl", "slot"])
    docs = np.bitwise_or.reduceat(np.left_shift(np.int64(1), slot), starts)
    columns = {
        "range": at_range[starts], "tok": words.take(pa.array(code[starts])), "entries": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
        "max_tf": np.maximum.reduceat(tf, starts), "min_dl": np.minimum.reduceat(dl, starts), "docs": docs, "n": np.diff(ends),
    }
    return pa.RecordBatch.from_pydict(columns)


def maker(width: int, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = size = last = 0
        for batch in (part for batch in batches for part in flat(batch)):
            if not batch.num_rows:
                continue
            ranges = batch.column(0).to_numpy()
            if (held and ranges[0] < last) or np.any(ranges[1:] < ranges[:-1]):
                raise ValueError("the tokenizer is to leave rows in their order, as it works row by row")
            last = ranges[-1]
            held.append(pa.Table.from_batches([batch]))
            n, size = n + batch.num_rows, size + batch.nbytes
            if n < ROWS and size < BYTES:
                continue
            whole = together(held)
            cut = int(np.searchsorted(whole["range"].to_numpy(), last))
            if cut:
                yield blocks_of(whole.slice(0, cut), width, key)
            rest = whole.slice(cut)
            if 2 * rest.num_rows >= ROWS or 2 * rest.nbytes >= BYTES:
                rest = summed(rest, width, key)
            held, n, size = [rest], 0, 0  # what comes to it is counted alone, so that a large range is not put together anew with each batch
        if held:
            yield blocks_of(together(held), width, key)

    return run


def together(held: list[pa.Table]) -> pa.Table:
    if any("tf" in t.column_names for t in held):
        held = [t if "tf" in t.column_names else t.append_column("tf", pa.array(np.ones(t.num_rows, np.int64))) for t in held]
        held = [t.select(held[0].column_names).cast(held[0].schema) for t in held]
    return pa.concat_tables(held)


def made_of(rows: DataFrame, width: int, key: str) -> DataFrame:
    """rows: range, slot, dl, key and tok, or toks (see sliced), and perhaps tf, each partition in order of range and no range in two -> range, tok, entries (key, tf, dl, slot), max_tf, min_dl, docs (a bit for each slot), n."""
    long = T.LongType()
    entry = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("tf", long), T.StructField("dl", long), T.StructField("slot", T.IntegerType())])
    fields = [("range", long), ("tok", T.StringType()), ("entries", T.ArrayType(entry)), ("max_tf", long), ("min_dl", long), ("docs", long), ("n", long)]
    return rows.mapInArrow(maker(width, key), T.StructType([T.StructField(c, t) for c, t in fields]))
