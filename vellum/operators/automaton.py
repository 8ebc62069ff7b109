"""Many strings in many texts, in one pass over each text: Aho-Corasick automata inside Spark tasks.

Where the distinct strings are at most `SENT_CHARS` characters together, they go along with the tasks and texts stay where
they are. Beyond that, strings are dealt to shards of about that size and texts to groups of about `GROUP_CHARS`, and each pair of a
shard and a group meets in a cogroup: no task holds more than one of each, and no string is held against a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENT_CHARS, GROUP_CHARS = 1 << 20, 1 << 24


def automata_of(pairs: Iterator[tuple[str, tuple]]) -> dict[tuple, ahocorasick.Automaton]:
    """One automaton for each scope."""
    found: dict[tuple, ahocorasick.Automaton] = {}
    for string, scope in pairs:
        found.setdefault(scope, ahocorasick.Automaton()).add_word(string, string)
    for a in found.values():
        a.make_automaton()
    return found


def counted(text: str, automaton) -> dict[str, int]:
    """The strings that stand in a text, with the number of places that do not overlap, from the left."""
    n: dict[str, int] = {}
    free: dict[str, int] = {}
    for last, string in automaton.iter(text):
        if last - len(string) + 1 >= free.get(string, 0):
            n[string] = n.get(string, 0) + 1
            free[string] = last + 1
    return n


def rows_of(batch: pa.Table | pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    """Some columns, row by row; without columns, an empty row each."""
    return zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in columns)) if columns else (() for _ in range(batch.num_rows))


def looked_through(batch: pa.Table | pa.RecordBatch, automata: dict, keep: list[str]) -> pa.RecordBatch:
    """The kept columns of each row, once for each string in its text."""
    rows, strings, counts = [], [], []
    names = batch.schema.names
    scopes = rows_of(batch, [c for c in names if c.startswith("_scope")])
    for k, (text, scope) in enumerate(zip(batch.column(names.index("_text")), scopes)):
        automaton, text = automata.get(scope), text.as_py()
        for string, n in counted(text, automaton).items() if automaton and text else ():
            rows.append(k)
            strings.append(string)
            counts.append(n)
    taken = [batch.column(names.index(c)).take(pa.array(rows, pa.int64())) for c in keep]
    taken = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken]
    return pa.record_batch([*taken, pa.array(strings, pa.string()), pa.array(counts, pa.int64())], [*keep, "_string", "_n"])


def occurrences(texts: DataFrame, key: list[str], text: str | Column, strings: DataFrame, string: str, on: list[str] = (), sent_chars: int = SENT_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """key and on of a text, string, n: each distinct string that stands in a text, with the same values in the columns `on`, and how often (without overlap).

    Empty strings and nulls, in strings, texts or `on`, match nothing. Rows of texts are taken one by one, so one that repeats gives its matches again.
    """
    on, spark = list(on), texts.sparkSession
    keep = list(dict.fromkeys([*key, *on]))
    scopes = [f"_scope{k}" for k in range(len(on))]
    there = lambda columns, rows: rows.where(F.forall(F.array(*(c.isNotNull() for c in columns)), lambda x: x)) if columns else rows
    probes = there([F.col(c) for c in on], strings).select(F.col(string).alias("_string"), *(F.col(c).alias(s) for c, s in zip(on, scopes))).where(F.length("_string") > 0).distinct()
    body = texts.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("_text"), *(F.col(c).alias(s) for c, s in zip(on, scopes)))
    schema = T.StructType([*body.select(*keep).schema.fields, T.StructField("_string", T.StringType()), T.StructField("_n", T.LongType())])
    size = probes.agg(F.sum(F.length("_string"))).first()[0] or 0
    if size <= sent_chars:
        sent = [(r[0], tuple(r[1:])) for r in probes.collect()]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = automata_of(iter(sent))
            for batch in batches:
                yield looked_through(batch, automata, keep)

        found = body.mapInArrow(search, schema)
    else:
        shards = -(-size // sent_chars)
        groups = max(1, -(-(body.agg(F.sum(F.length("_text"))).first()[0] or 0) // group_chars))
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = body.withColumn("_group", F.monotonically_increasing_id() % groups).withColumn("_shard", all_of(shards))
        probes = probes.withColumn("_shard", F.pmod(F.xxhash64("_string"), F.lit(shards)).cast("int")).withColumn("_at", all_of(groups)).withColumn("_group", F.col("_at").cast("long"))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            pairs = zip(right.column("_string").to_pylist(), rows_of(right, scopes))
            return pa.Table.from_batches([looked_through(left, automata_of(pairs), keep)])

        found = dealt.groupBy("_group", "_shard").cogroup(probes.groupBy("_group", "_shard")).applyInArrow(meet, schema)
    return found.withColumnsRenamed({"_string": string, "_n": "n"})
