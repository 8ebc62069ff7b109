"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame. All but
the last return the columns of docs. run() writes each stage's result as Parquet in the shared folder
and reads it again as the next one's docs.

In every stage: a null text is an empty one, and stays null where the row stays; a null doc_id is a document
like any other; rows that repeat are documents of their own, but where a stage says otherwise; an empty table gives
an empty one; columns besides those named are passed on, whatever their names; texts of any length are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import Scratch, table
from vellum.llm.mixing import mix
from vellum.llm.packing import pack
from vellum.llm.registry import vocabulary
from vellum.llm.suffix_dedup import without_repeats
from vellum.llm.superminhash import keep_one
from vellum.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels beside the corpus (without positives nothing goes). Rows of one text stay or go together."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least doc_id: shingles of five words, similarity 0.8. Documents without words are linked with nothing and stay; rows that repeat a doc_id and a text stay or go together."""
    return keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters wholly covered by 200-byte strings that repeat go; every document stays, emptied ones too, and n_chars follows its text."""
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none more than twice."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens. An empty document is its end id alone."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packing", packing)]

#: SQL cannot express the stages (a trained model, hashes of the mix, a tokenizer). tests/llm/test_pipeline.py holds each stage, and run() as a
#: whole, against brute force: kept rows, cut texts, pieces; of the mix, which rows it takes is the operator's own choice, held to its report.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
