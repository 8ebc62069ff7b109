"""Markdown corpora: files with front matter, and lines with annotation comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, text of each file but README.md."""
    read = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    return read.where(F.col("source_file") != "README.md")


def asserted(records: DataFrame, by: str, expected: dict[str, int], key: str) -> DataFrame:
    """The records, if each kind has the expected number and no key stands twice; else an error that says which."""
    have = {r[0]: r[1] for r in records.groupBy(by).agg(F.count("*")).collect()}  # a row for each kind
    wrong = {k: (expected.get(k, 0), have.get(k, 0)) for k in expected.keys() | have.keys() if expected.get(k, 0) != have.get(k, 0)}
    twice = [r[0] for r in records.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if wrong or twice:
        raise ValueError(f"expected and found by {by}: {wrong}; repeated {key}: {twice}")
    return records


def last_of_each(entries: Column) -> Column:
    """A map of (key, value) entries; of a repeated key the last one holds."""
    later = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]).alias("again")))
    return F.map_from_entries(F.transform(F.filter(later, lambda e: ~e["again"]), lambda e: F.struct(e["key"], e["value"])))


def entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def stripped(c: Column, signs: str = r"\s") -> Column:
    return F.regexp_replace(c, rf"(?U)^[{signs}]+|[{signs}]+$", "")


def front_matter(text: Column) -> Column:
    """struct(meta map<string,string>, body): `key: value` lines between two rules at the start; null without them."""
    block = F.regexp_extract(text, r"^---\n((?s:.*?))\n?---\n", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 0)
    value = lambda x: stripped(stripped(F.regexp_replace(x, r"^[^:]*:", "")), '"')
    meta = last_of_each(F.transform(pairs, lambda x: entry(stripped(F.substring_index(x, ":", 1)), value(x))))
    return F.when(text.startswith("---\n"), F.struct(meta.alias("meta"), F.regexp_replace(text, r"^---\n(?s:.*?)\n?---\n", "").alias("body")))


def lenient_front_matter(text: Column) -> Column:
    """struct(meta, body) of a text cut at rules: the second part's `word: value` lines, and all that follows it."""
    parts = F.split(text, "---\n", -1)
    pairs = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: x.rlike(r"^\w+:\s*.+$"))
    meta = last_of_each(F.transform(pairs, lambda x: entry(F.regexp_extract(x, r"^(\w+):", 1), stripped(stripped(F.regexp_extract(x, r"^\w+:\s*(.+)$", 1)), '"'))))
    return F.when(F.size(parts) > 1, F.struct(meta.alias("meta"), F.array_join(F.slice(parts, 3, 1 << 30), "---\n").alias("body")))


def annotations(line: Column) -> Column:
    """The map of a comment line `<!-- k: v | flag -->` (a bare flag maps to 'true', of a repeated key the last holds), else null."""
    inner = F.regexp_extract(line, r"^\s*<!--\s*(.*?)\s*-->\s*$", 1)
    said = lambda x: entry(stripped(F.substring_index(x, ":", 1)), F.when(F.instr(x, ":") > 0, stripped(F.regexp_replace(x, r"^[^:]*:", ""))).otherwise(F.lit("true")))
    parts = F.filter(F.split(inner, r"\|"), lambda x: stripped(x) != "")
    return F.when(inner != "", last_of_each(F.transform(parts, said)))


def write_markdown(rows: DataFrame, path: str, key: str, order: str, line: str) -> None:
    """One file's text per key, lines in order, runs of three or more line feeds reduced to two; partitioned by key."""
    text = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n"), r"\n{3,}", "\n\n")
    rows.groupBy(key).agg(text.alias("value")).write.mode("overwrite").partitionBy(key).text(path)
