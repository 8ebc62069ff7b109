"""A corpus of files as a data source: `spark.read.format("vellum_corpus").load("folder/*")`, and `readStream` for what arrives later.

One row for each line of a markdown file (part `front` for its front matter, `body` for the rest), each paragraph and table cell of an
OOXML document (part `document`) and each of its notes (part `notes`), and each line of a .jsonl file (part `lines`). A partition is one
part of one file. Filters on path and part are taken out of the plan and choose partitions; those on kind, by equality or `in`, are applied as
rows are read. A stream's offset is the time of change up to which files were read, so a file that changes comes again, under its path.

Files are opened by the executors where they lie: a folder that all of them see, or a store that Arrow's file systems know. Through Spark's own
readers the same files come with vellum.sources.markdown, ooxml and files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path string, part string, pos int, kind string, text string"
COLUMNS = pa.schema([("path", pa.string()), ("part", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string())])
PARTS = {".md": ["front", "body"], ".docx": ["document", "notes"], ".jsonl": ["lines"]}
BATCH = 4096


@dataclass
class Part(InputPartition):
    path: str
    part: str


def listed(pattern: str) -> list[tuple[str, int]]:
    """Files that match, with the time of their last change in nanoseconds. The last step of the pattern may hold wild cards; a folder stands for its files."""
    fs, path = pyarrow.fs.FileSystem.from_uri(pattern if "://" in pattern else f"file://{pattern}")
    folder, _, name = path.rpartition("/")
    if not any(c in name for c in "*?["):
        info = fs.get_file_info(path)
        if info.type == pyarrow.fs.FileType.File:
            return [(pattern, info.mtime_ns or 0)]
        folder, name = path, "*"
    prefix = pattern[: -len(path)] if pattern.endswith(path) else ""
    found = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    return sorted((prefix + f.path, f.mtime_ns or 0) for f in found if f.type == pyarrow.fs.FileType.File and fnmatch(f.base_name, name) and suffix(f.path) in PARTS and f.base_name != "README.md")


def suffix(path: str) -> str:
    return "." + path.rpartition(".")[2].lower()


def content(path: str) -> bytes:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_stream(inner) as f:
        return f.read()


def markdown_lines(text: str, part: str) -> Iterator[tuple[int, str, str]]:
    lines = text.split("\n")
    rule = next((i for i, line in enumerate(lines) if i and line == "---"), 0) if lines[0] == "---" else 0
    for i, line in enumerate(lines):
        front = bool(rule) and i <= rule
        if front == (part == "front") and not (front and line == "---"):
            kind = "meta" if front else "comment" if re.match(r"\s*<!--.*-->\s*$", line) else "section" if line.startswith("## ") else "text" if line.strip() else "blank"
            yield i, kind, line


def rows_of(path: str, part: str) -> Iterator[tuple[int, str, str]]:
    data = content(path)
    if suffix(path) == ".docx":
        from vellum.sources.ooxml import events

        yield from ((e["pos"], e["kind"], e["text"]) for e in events(data) if (e["kind"] == "note") == (part == "notes"))
    elif suffix(path) == ".jsonl":
        yield from ((i, "json", line) for i, line in enumerate(data.decode().split("\n")) if line.strip())
    else:
        yield from markdown_lines(data.decode().removesuffix("\n"), part)


class Wanted:
    """What pushed filters leave. Each filter is one that is taken over wholly, or is left to Spark."""

    def __init__(self):
        self.tests: list[tuple[str, type, object]] = []

    def take(self, f: Filter) -> bool:
        column, kinds = getattr(f, "attribute", (None,))[0], (EqualTo, In, StringStartsWith, StringEndsWith)
        if column not in ("path", "part", "kind") or type(f) not in kinds:
            return False
        self.tests.append((column, type(f), f.value))
        return True

    def has(self, column: str, value: str) -> bool:
        says = {EqualTo: lambda v: value == v, In: lambda v: value in v, StringStartsWith: lambda v: value.startswith(v), StringEndsWith: lambda v: value.endswith(v)}
        return all(says[kind](v) for c, kind, v in self.tests if c == column)


def read_part(p: Part, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    rows = []
    for pos, kind, text in rows_of(p.path, p.part):
        if wanted.has("kind", kind):
            rows.append((p.path, p.part, pos, kind, text))
        if len(rows) == BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), COLUMNS.types)], schema=COLUMNS)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), COLUMNS.types)], schema=COLUMNS)


class CorpusReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern, self.wanted = pattern, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Part]:
        return [Part(path, part) for path, _ in listed(self.pattern) for part in PARTS[suffix(path)] if self.wanted.has("path", path) and self.wanted.has("part", part)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(partition, self.wanted)


class CorpusStreamReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((t for _, t in listed(self.pattern)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(path, part) for path, t in listed(self.pattern) if start["changed"] < t <= end["changed"] for part in PARTS[suffix(path)]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(partition, Wanted())


class Corpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options["path"])

    def streamReader(self, schema) -> CorpusStreamReader:
        return CorpusStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Corpus)
