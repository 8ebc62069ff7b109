"""Suffix-array dedup by prefix-free parsing: bytes covered by a 200-byte string that starts twice or more in the corpus.

1. Each scan task parses its texts at rolling-hash triggers and writes narrow rows, a phrase of each
   (a row for some 80 bytes). A trigger is the least rolling hash of a 200-byte window, not a fixed
   remainder, so that phrases are bounded and no 200 bytes are without one, however repetitive the text.
2. The dictionary counts each entry (trigger and content of a phrase), with partial sums. All windows
   of an entry that occurs twice are repeated.
3. Of triggers with several entries, the first occurrence of each (an entry that occurs more often weighs
   2) is put in corpus order. An order of all bytes would write a row for each; as only neighbours with
   200 bytes in common count, entries are dealt by key ranges instead: a stretch of an entry's windows
   goes, with its bytes, where its core (the 169 bytes all its windows hold) goes, and only if that core
   stands elsewhere too. There two suffix arrays are built, by bytes and with the common prefixes of
   neighbours: of what precedes the core in the dictionary, read backwards, and of what follows in the
   parse. A window is the end of one and the beginning of the other, so its class is its place in both,
   and one whose class weighs 2 or more is repeated.
4. A core in more than `GROUP` entries would crowd one task; its windows are counted one by one instead, by
   96-bit hashes with partial sums.
5. Repeated phrases and windows go back to their texts, which are cut.

Nulls: a null text is empty, a null doc_id is kept. Repeated rows are documents of their own: they
repeat each other. Texts under 200 bytes lose nothing. Empty tables give empty results. Very long texts
are parsed a million bytes at a time. Other columns are not read; without_repeats passes them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.llm.common import Scratch, quoted, sliced, text_or_empty
from vellum.llm.repeats import CORES, KEY, PHRASES, WINDOWS, Units, cores_of, covered, phrases, windows_of

BYTES = Units("bytes", 200, 48, 32)
NO_ID = (1 << 63) - 1
#: Entries of a core that one task may order at once, and about how many it takes at a time.
GROUP = 20_000
PIECES = "core long, id long, text_hash long, start int, windows int, lead int, weight int, bytes binary"
SPANS = "id long, text_hash long, start int, end int"


def keyed(docs: DataFrame) -> DataFrame:
    """id (a null one is the greatest), text_hash, text as UTF-8."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_or_empty(docs)).alias("text_hash"), text_or_empty(docs).cast("binary").alias("text"))


def gathered(spans: DataFrame) -> DataFrame:
    """The spans of a text in one row: never more than it has units."""
    return spans.groupBy(*KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def repeated_spans(docs: DataFrame, scratch: Scratch, units: Units = BYTES, group: int = GROUP) -> DataFrame:
    """id, text_hash, starts, ends: a row for each text with repeated windows."""
    texts = keyed(docs)
    parsed = scratch.write(texts.mapInArrow(phrases(units), PHRASES), "phrases")
    entry = ["trigger_hash", "phrase_hash"]
    dictionary = parsed.groupBy(*entry).agg(F.count("*").alias("n"), F.min(F.struct("id", "start", "text_hash", "windows", "at")).alias("first"))
    dictionary = scratch.write(dictionary, "dictionary")
    often = dictionary.where("n > 1").select(*entry)
    whole = scratch.write(parsed.join(often, entry, "left_semi").select(*KEY, "start", (F.col("start") + F.col("windows") + (units.window - 1)).alias("end")), "whole")
    scratch.drop("phrases")

    several = dictionary.groupBy("trigger_hash").agg(F.count("*").alias("entries")).where("entries > 1").select("trigger_hash")
    open_ = dictionary.join(several, "trigger_hash", "left_semi").select("first.*", F.least("n", F.lit(2)).alias("weight"))
    parts = corpus_order(texts, open_, units, scratch, group)
    spans = scratch.write(gathered(whole.unionByName(parts)), "spans")
    scratch.drop("dictionary", "whole", "ordered", "alone", "live")
    return spans


def corpus_order(texts: DataFrame, open_: DataFrame, units: Units, scratch: Scratch, group: int) -> DataFrame:
    """SPANS of the windows of weight 1 that repeat. texts: id, text_hash, text; open_: KEY, start, windows, at, weight of phrases."""
    open_ = open_.groupBy(*KEY).agg(*(F.collect_list(c).alias(c) for c in ("start", "windows", "weight", "at")))
    cores = texts.join(scratch.write(open_, "open"), KEY).select(*KEY, "text", "start", "windows", "weight", "at").mapInArrow(cores_of(units), CORES)
    cores = scratch.write(cores, "cores")
    again = cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    live = scratch.write(cores.join(again, "core"), "live")
    scratch.drop("open", "cores")
    lists = lambda rows, *columns: rows.groupBy(*KEY).agg(*(F.collect_list(c).alias(c) for c in columns))
    few = lists(live.where(F.col("n") <= group), "start", "windows", "weight", "lead", "core")
    pieces = texts.join(few, KEY).select(*KEY, "text", "start", "windows", "weight", "lead", "core").mapInArrow(pieces_of(units), PIECES)
    found = scratch.write(pieces.repartition("core").sortWithinPartitions("core").mapInArrow(neighbours(units), SPANS), "ordered")
    many = live.where(F.col("n") > group)
    if many.isEmpty():
        return found
    alone = texts.join(lists(many, "start", "windows", "weight"), KEY).select(*KEY, "text", "start", "windows", "weight").mapInArrow(windows_of(units), WINDOWS)
    alone = scratch.write(alone.dropDuplicates([*KEY, "start"]), "windows")
    twice = alone.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2")
    alone = alone.where("weight = 1").join(twice, ["w1", "w2"], "left_semi").select(*KEY, "start", (F.col("start") + units.window).alias("end"))
    alone = scratch.write(alone, "alone")
    scratch.drop("windows")
    return found.unionByName(alone)


def pieces_of(units: Units):
    """(id, text_hash, text, starts, windows, weights, leads, cores) -> PIECES: the stretches of a text with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                start, many, weight, lead, core = (batch.column(k)[i].as_py() for k in range(3, 8))
                text = batch.column(2)[i].as_py()
                row = pa.array(np.full(len(start), i))
                cut = [text[s : s + n + units.window - 1] for s, n in zip(start, many)]
                yield pa.record_batch([pa.array(core, pa.int64()), batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x, pa.int32()) for x in (start, many, lead, weight)), pa.array(cut, pa.binary())], [c.split()[0] for c in PIECES.split(", ")])

    return run


def sorted_with_prefixes(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings, padded to `width`, and how much each has in common with the one before it."""
    x = np.array(rows, f"S{width}")
    order = np.argsort(x, kind="stable")
    x = x[order].view(np.uint8).reshape(len(rows), width)
    differ = x[1:] != x[:-1]
    return order, np.where(differ.any(1), differ.argmax(1), width)


def repeated_windows(units: Units, many: np.ndarray, lead: np.ndarray, weight: np.ndarray, cut: list[bytes]) -> np.ndarray:
    """Of pieces: for each of its windows whether its class weighs 2 or more."""
    m, width = len(cut), units.stretch - 1
    order, after = sorted_with_prefixes([c[n : n + units.window] for c, n in zip(cut, lead)], units.window)
    back, before = sorted_with_prefixes([c[:n][::-1] for c, n in zip(cut, lead)], max(1, width))
    found, what_follows, what_precedes = np.zeros((m, units.stretch), bool), np.empty(m, np.int64), np.empty(m, np.int64)
    for left in range(units.stretch):
        who = np.flatnonzero((left <= lead) & (left > lead - many))
        if len(who):
            what_follows[order] = np.r_[0, np.cumsum(after < units.window - left)]
            what_precedes[back] = np.r_[0, np.cumsum(before < left)]
            _, of = np.unique(what_follows[who] * m + what_precedes[who], return_inverse=True)
            found[who, lead[who] - left] = np.bincount(of, weight[who])[of] > 1
    return found


def neighbours(units: Units):
    """PIECES, sorted by core -> SPANS of those of weight 1 that repeat. A core's pieces are ordered together."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        key = rows.select(["id", "text_hash", "start"]).to_pandas()
        rows = rows.filter(pa.array(~key.duplicated().to_numpy()))  # rows that repeat an id and text are one text here
        ids, text_hash, start, many, lead, weight = (np.asarray(rows.column(c).combine_chunks()) for c in ("id", "text_hash", "start", "windows", "lead", "weight"))
        found = repeated_windows(units, many, lead, weight, rows.column("bytes").to_pylist()) & (weight == 1)[:, None]
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (of, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.record_batch([pa.array(ids[of]), pa.array(text_hash[of]), pa.array((start[of] + first).astype(np.int32)), pa.array((start[of] + last + units.window - 1).astype(np.int32))], ["id", "text_hash", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= GROUP:
                rows = pa.Table.from_batches(held)
                cores = np.asarray(rows.column("core").combine_chunks())
                whole = int(np.searchsorted(cores, cores[-1]))  # the last core may go on
                if whole:
                    yield settle(rows.slice(0, whole))
                held, size = rows.slice(whole).to_batches(), size - whole
        if size:
            yield settle(pa.Table.from_batches(held))

    return run


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, starts, ends) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    for batch in sliced(batches):
        rows = []
        for text, starts, ends in zip(*(batch.column(k) for k in (1, 2, 3))):
            text, kept = text.as_py(), text.as_py()
            gone, runs = 0, 0
            if starts.is_valid:
                mask = covered(len(text), starts.as_py(), ends.as_py())
                gone, runs = int(mask.sum()), int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            rows.append((len(text), gone, runs, hashlib.sha256(kept).hexdigest()))
        n, gone, runs, digest = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, starts, ends, rest) -> (text, rest): characters that are wholly covered go."""
    for batch in sliced(batches):
        texts = []
        for text, starts, ends in zip(*(batch.column(k) for k in range(3))):
            text = text.as_py()
            if text is not None and starts.is_valid:
                raw = np.frombuffer(text.encode(), np.uint8)
                mask = covered(len(raw), starts.as_py(), ends.as_py())
                of = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
                whole = np.bincount(of, weights=~mask) == 0
                text = raw[~whole[of]].tobytes().decode()
            texts.append(text)
        yield pa.record_batch([pa.array(texts, pa.string()), batch.column(3)], ["text", "rest"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == spans["id"], F.xxhash64(text_or_empty(docs)) == spans["text_hash"]]
    return docs.join(spans, key, "left")


def suffix_dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs."""
    spans = repeated_spans(docs, Scratch(docs.sparkSession, "suffix-dedup"), group=group)
    rows = with_spans(docs, spans).select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).cast("binary").alias("text"), spans["starts"], spans["ends"])
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows of docs, their texts without what repeats; n_chars follows the text."""
    spans = repeated_spans(docs, Scratch(docs.sparkSession, "suffix-dedup"))
    rest = [c for c in docs.columns if c != "text"]
    rows = with_spans(docs, spans).select(docs["text"].cast("string").alias("text"), spans["starts"], spans["ends"], F.struct(*(docs[quoted(c)].alias(c) for c in rest)).alias("rest"))
    done = rows.mapInArrow(kept_text, StructType([StructField("text", StringType()), rows.schema["rest"]]))
    columns = {c: F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("rest").getField(c) for c in docs.columns}
    return done.select(*(x.alias(c) for c, x in columns.items()))
