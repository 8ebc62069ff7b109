"""Which strings stand in which texts, without holding every string against every text.

The hashes of all runs of `GRAM` characters are taken, and of each `WINDOW` consecutive ones the least. A string that
stands in a text brings its windows with it, so the least hash of its first window is among the text's. Joined on
that, a pair is a candidate, and is then looked at. Strings shorter than one window are found by automata, in one pass over each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.automaton import occurrences

GRAM, WINDOW = 16, 8
SHORTEST = GRAM + WINDOW - 1
SENT_HASHES = 1 << 18  # of a task's hashes, that many go on at once
BATCH_BYTES, USUAL, MODEST = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str) -> np.ndarray:
    signs = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(signs) - GRAM + 1
    found = np.zeros(max(0, n), np.uint64)
    for j in range(GRAM if n > 0 else 0):
        found = found * ODD + signs[j : j + n]
    return (found ^ (found >> np.uint64(29))) * ODD


def least_hashes(text: str | None) -> np.ndarray:
    """The least hash of every window of a text, each once."""
    if text is None or len(text) < SHORTEST:
        return np.zeros(0, np.int64)
    h = gram_hashes(text)
    n = len(h) - WINDOW + 1
    least = h[:n]
    for j in range(1, WINDOW):
        least = np.minimum(least, h[j : j + n])
    return np.unique(least).view(np.int64)


def hashes_of(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([least_hashes(x) for x in s], dtype=object), "array<long>")(c)


def first_hash(c: Column) -> Column:
    return F.get(hashes_of(F.substring(c, 1, SHORTEST)), F.lit(0))


def marked(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, _h: a row for each least hash of a text. Texts are taken one by one and hashes stay arrays, so a task holds those of SENT_HASHES and one text at most."""
    rows = texts.select(*key, F.col(text).alias("_text"))
    schema = T.StructType([*rows.select(*key).schema.fields, T.StructField("_h", T.LongType())])

    def flat(batch: pa.RecordBatch, places: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        at = pa.array(np.repeat(places, [len(h) for h in found]))
        return pa.record_batch([*(batch.column(k).take(at) for k in range(len(key))), pa.array(np.concatenate(found))], [*key, "_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found, n = [], [], 0
            for k, text in enumerate(batch.column(len(key))):
                h = least_hashes(text.as_py())
                if len(h):
                    places, found, n = [*places, k], [*found, h], n + len(h)
                if n >= SENT_HASHES:
                    yield flat(batch, places, found)
                    places, found, n = [], [], 0
            if n:
                yield flat(batch, places, found)

    return rows.mapInArrow(run, schema)


def contained(texts: DataFrame, key: list[str], text: str, strings: DataFrame, string: str, on: list[str] = ()) -> DataFrame:
    """key of a text and the columns of a string for each string that stands in it; rows of strings and keys are distinct, and agree in the columns `on`."""
    on, conf = list(on), texts.sparkSession.conf
    if conf.get(BATCH_BYTES, USUAL) == USUAL:  # the caller runs what is returned here, under the session's settings: long texts reach Python in smaller batches
        conf.set(BATCH_BYTES, MODEST)
    asked = strings.select(*strings.columns, first_hash(F.col(string)).alias("_h"))
    for c in on:
        asked = asked.withColumnRenamed(c, f"_{c}")
    of_texts = marked(texts, list(dict.fromkeys([*key, *on])), text)
    equal = [of_texts["_h"] == asked["_h"], *(of_texts[c] == asked[f"_{c}"] for c in on)]
    pairs = of_texts.join(asked.where("_h is not null"), equal).select(*(of_texts[k] for k in key), *(F.col(c) for c in asked.columns if c != "_h")).distinct()
    held = texts.select(*(F.col(k).alias(f"_k_{k}") for k in key), F.col(text).alias("_t"))
    long = pairs.join(held, [F.col(k) == F.col(f"_k_{k}") for k in key]).where(F.contains("_t", string)).drop("_t", *(f"_k_{k}" for k in key))
    found = long
    for c in on:
        found = found.drop(c).withColumnRenamed(f"_{c}", c) if c not in key else found.drop(f"_{c}")
    short = strings.where((F.length(string) > 0) & (F.length(string) < SHORTEST))
    hits = occurrences(texts, key, text, short, string, on).drop("n")
    return found.unionByName(hits.join(short, [string, *on]).select(*found.columns))
