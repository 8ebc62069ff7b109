"""The corpus format: rows and parts, filters that choose what is opened, streams that read what is new."""

import os
import time

from test_conversion import docx, p

from vellum.sources import formats


def make(tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: x\n---\n## One\ntext\n\n<!-- kind: y -->\nmore\n")
    (tmp_path / "b.md").write_text("no front\n---\nmatter")
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "README.md").write_text("not part of it")
    (tmp_path / "d.txt").write_text("nor this")
    docx(tmp_path, "e.docx", p("first") + p("second"), footnotes=f"<w:footnote>{p('note')}</w:footnote>")


def test_rows_and_filters(spark, tmp_path):
    make(tmp_path)
    formats.register(spark)
    rows = spark.read.format("vellum_corpus").load(str(tmp_path))
    found = sorted((os.path.basename(r.path), r.part, r.pos, r.kind, r.text) for r in rows.collect())
    assert found == [
        ("a.md", "body", 3, "section", "## One"), ("a.md", "body", 4, "text", "text"), ("a.md", "body", 5, "blank", ""), ("a.md", "body", 6, "comment", "<!-- kind: y -->"), ("a.md", "body", 7, "text", "more"), ("a.md", "front", 1, "meta", "title: x"),
        ("b.md", "body", 0, "text", "no front"), ("b.md", "body", 1, "text", "---"), ("b.md", "body", 2, "text", "matter"), ("c.jsonl", "lines", 0, "json", '{"a": 1}'), ("c.jsonl", "lines", 2, "json", '{"a": 2}'),
        ("e.docx", "document", 0, "p", "first"), ("e.docx", "document", 1, "p", "second"), ("e.docx", "notes", 2, "note", "note"),
    ]
    assert {r.text for r in rows.where("kind in ('section', 'comment') and part = 'body'").collect()} == {"## One", "<!-- kind: y -->"}
    notes = rows.where("part = 'notes'")
    assert [r.text for r in notes.collect()] == ["note"] and notes.rdd.getNumPartitions() == 1
    some = rows.where("path like '%/a.md' and kind = 'text' and pos > 4")
    assert [r.text for r in some.collect()] == ["more"] and some.rdd.getNumPartitions() == 2
    assert spark.read.format("vellum_corpus").load(str(tmp_path / "*.jsonl")).count() == 2


def test_what_is_left_to_spark():
    reader = formats.CorpusReader("/nowhere")
    mine, theirs = formats.EqualTo(("kind",), "text"), formats.EqualTo(("pos",), 3)
    assert list(reader.pushFilters([mine, theirs])) == [theirs]


def test_a_stream_reads_what_is_new(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    formats.register(spark)

    def run():
        rows = spark.readStream.format("vellum_corpus").load(str(inbox))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.basename(r.path), r.text) for r in spark.read.parquet(out).collect())

    (inbox / "a.md").write_text("one")
    assert run() == [("a.md", "one")] == run()
    time.sleep(0.02)
    (inbox / "b.md").write_text("two")
    assert run() == [("a.md", "one"), ("b.md", "two")]
