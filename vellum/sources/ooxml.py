"""OOXML files as Arrow-batched scans of binary files: paragraphs and table cells in order, notes, two-column tables, list numbers."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import ascii_share

#: Names of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SKIP = {W + "del", W + "instrText", W + "delText", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"}
BLANKS = {W + "tab", W + "br", W + "cr"}
#: What stands for a paragraph's number at the head of a line, and the title of a part of a combined file.
LITERAL_NUMBER = r"^(한\s?\d+(?:\.\d+)*[A-Z]?|\d+(?:\.\d+)*[A-Z]?(?:\.\d+)*|[A-Z]{1,3}\d+[A-Z]?(?:\.\d+)*|BC[A-Z]{1,2}\.?\d+(?:\.\d+)*[A-Z]?|[A-Z]\d+[A-Z]?)(?=\s|\x{a0}|$)"
MAX_ASCII = 0.7
TITLE_STYLE, TITLE = "10", r"^(?:감사기준서|품질관리기준서)\s*(\d+)(?:\s|$)"
MAX_SECTION, MAX_BASES = 40, 10


def text_of(node: ET.Element) -> str:
    if node.tag in SKIP:
        return ""
    if node.tag == W + "t":
        return node.text or ""
    return " " if node.tag in BLANKS else "".join(map(text_of, node))


def inside(node: ET.Element, tag: str) -> Iterator[ET.Element]:
    """Elements of a tag in order, without what was deleted and without fallbacks."""
    for child in node:
        if child.tag == tag:
            yield child
        elif child.tag not in SKIP:
            yield from inside(child, tag)


def blocks(body: ET.Element) -> Iterator[tuple[str, ET.Element]]:
    """(kind, paragraph): p outside tables; cell for each paragraph of each cell."""
    for child in body:
        if child.tag == W + "p":
            yield "p", child
        elif child.tag == W + "tbl":
            for cell in inside(child, W + "tc"):
                for p in cell.iter(W + "p"):
                    yield "cell", p
        elif child.tag not in SKIP:
            yield from blocks(child)


class Numbering:
    """The list definitions and styles of a file: what list, level and format a paragraph has, by itself or through its styles."""

    def __init__(self, z: zipfile.ZipFile):
        def root(name: str) -> ET.Element:
            return ET.fromstring(z.read(name)) if name in z.namelist() else ET.Element("none")

        value = lambda node, path, default=None: default if node is None or (x := node.find(path)) is None else x.get(W + "val")
        lists, styles = root("word/numbering.xml"), root("word/styles.xml")
        self.levels, self.abstract, self.starts, self.of_style = {}, {}, {}, {}
        for a in lists.iter(W + "abstractNum"):
            self.levels[a.get(W + "abstractNumId")] = {int(v.get(W + "ilvl")): (value(v, W + "numFmt", "decimal"), value(v, W + "lvlText", ""), int(value(v, W + "start", "1"))) for v in a.iter(W + "lvl")}
        for n in lists.iter(W + "num"):
            self.abstract[n.get(W + "numId")] = value(n, W + "abstractNumId")
            for o in n.iter(W + "lvlOverride"):
                if (start := value(o, W + "startOverride")) is not None:
                    self.starts[n.get(W + "numId"), int(o.get(W + "ilvl"))] = int(start)
        known = {s.get(W + "styleId"): s for s in styles.iter(W + "style")}
        for name in known:
            at, left = name, MAX_BASES
            while at in known and left and name not in self.of_style:
                own = known[at].find(f"{W}pPr/{W}numPr")
                if own is not None:
                    self.of_style[name] = (value(own, W + "numId"), int(value(own, W + "ilvl", "0")))
                at, left = value(known[at], W + "basedOn"), left - 1
        self.value = value

    def of(self, p: ET.Element) -> dict:
        style = self.value(p, f"{W}pPr/{W}pStyle")
        own = p.find(f"{W}pPr/{W}numPr")
        number = self.value(own, W + "numId")
        list_id, level = (number, int(self.value(own, W + "ilvl", "0"))) if number is not None else self.of_style.get(style, (None, 0))
        if list_id == "0":
            list_id = None
        kind, template, start = self.levels.get(self.abstract.get(list_id), {}).get(level, (None, None, None))
        if self.abstract.get(list_id) not in self.levels:
            list_id = None
        return {"style": style, "list_id": list_id, "abstract_id": self.abstract.get(list_id), "level": level, "format": kind, "template": template, "start": start, "override": self.starts.get((list_id, level))}


def events(content: bytes) -> list[dict]:
    """pos, kind, text, and a paragraph's style and list: p outside tables, cell for each paragraph of a cell, note for each foot- or endnote. Empty ones are left out, and use up no number."""
    found = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        lists = Numbering(z)
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
        for kind, p in blocks(body if body is not None else ET.Element("none")):
            if text := text_of(p).strip():
                found.append({"kind": kind, "text": text, **(lists.of(p) if kind == "p" else {})})
        for name, tag in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
            for note in ET.fromstring(z.read(name)).iter(W + tag) if name in z.namelist() else ():
                if text := " ".join(text_of(p) for p in note.iter(W + "p")).strip():
                    found.append({"kind": "note", "text": text})
    return [{"pos": i, **e} for i, e in enumerate(found)]


def table_events(content: bytes) -> list[dict]:
    """pos, kind, number, text of the table with most rows of its own: a row of one cell, or a short one without a number, is a section; others are paragraphs with their continuations."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    own = lambda node, tag: [x for x in node if x.tag == W + tag]
    plain = lambda p: "".join(t.text or "" for t in p.iter(W + "t")).strip()
    tables, found = list(root.iter(W + "tbl")), []
    for row in own(max(tables, key=lambda t: len(own(t, "tr"))), "tr") if tables else ():
        cells = own(row, "tc")
        texts = [x for x in map(plain, cells[1].iter(W + "p")) if x] if len(cells) == 2 else []
        number = plain(cells[0]) if cells else ""
        if len(cells) == 1 and number:
            found.append(("section", None, number))
        elif texts and not number and len(texts) == 1 and len(texts[0]) <= MAX_SECTION:
            found.append(("section", None, texts[0]))
        elif texts and number:
            found += [("para", number, texts[0]), *(("cont", None, "\t" + t) for t in texts[1:])]
        else:
            found += [("cont", None, t) for t in texts]
    return [{"pos": i, "kind": k, "number": n, "text": t} for i, (k, n, t) in enumerate(found)]


EVENTS = "path string, pos int, kind string, text string, style string, list_id string, abstract_id string, level int, format string, template string, start double, override double"
DEFINITIONS, STARTS = "path string, abstract_id string, level int, format string, template string, start int", "path string, list_id string, level int, override int"
TABLE_EVENTS = "path string, pos int, kind string, number string, text string"


def _scan(spark: SparkSession, paths: str | list[str], read: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_pylist([{"path": path, **e} for e in read(content.as_py())], schema=kinds)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, schema)


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _scan(spark, paths, events, EVENTS)


def list_definitions(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Every level of every abstract list, and every list's own starts, as numbering.numbering_expand takes them."""

    def lists(content: bytes) -> Numbering:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return Numbering(z)

    levels = lambda content: [{"abstract_id": a, "level": k, "format": f, "template": t, "start": s} for a, of in lists(content).levels.items() for k, (f, t, s) in of.items()]
    starts = lambda content: [{"list_id": n, "level": k, "override": s} for (n, k), s in lists(content).starts.items()]
    return _scan(spark, paths, levels, DEFINITIONS), _scan(spark, paths, starts, STARTS)


def scan_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _scan(spark, paths, table_events, TABLE_EVENTS)


def literal_number(kind: Column, text: Column) -> Column:
    """The number at the head of a paragraph's text, or null; lines mostly in ASCII, as addresses are, have none."""
    found = F.regexp_extract(text, LITERAL_NUMBER, 1)
    return F.when((kind == "p") & (found != "") & (ascii_share(text) < MAX_ASCII), F.regexp_replace(found, " ", ""))


def paragraph_number(label: Column) -> Column:
    """The number that an expanded list label gives a paragraph: digits with a period, perhaps after an A."""
    found = F.regexp_extract(label, r"^(A?\d+)\.$", 1)
    return F.when(found != "", found)


def split_combined(rows: DataFrame) -> DataFrame:
    """Adds standard: the number in the last title so far, of the style of titles; `preamble` before the first."""
    title = F.when(F.col("style") == TITLE_STYLE, F.nullif(F.regexp_extract("text", TITLE, 1), F.lit("")))
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("standard", F.coalesce(F.last(title, True).over(upto), F.lit("preamble")))
