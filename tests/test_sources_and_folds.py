"""Small fixtures for sources, folds, glossary forms and the incremental build."""

import io
import zipfile

from pyspark.sql import functions as F


def test_front_matter_and_annotations(spark):
    from vellum.sources.markdown import annotations, front_matter

    row = spark.createDataFrame([('---\na: "x: y"\nb: z\n---\nbody\n---\nmore', "<!-- kind: p | idx: 3 | open -->"), ("no front", "text")], "t string, l string").select(front_matter(F.col("t")).alias("f"), annotations(F.col("l")).alias("a")).collect()
    assert row[0].f.meta == {"a": "x: y", "b": "z"} and row[0].f.body == "body\n---\nmore" and row[0].a == {"kind": "p", "idx": "3", "open": "true"}
    assert row[1].f is None and row[1].a is None


def test_ooxml(spark, tmp_path):
    from vellum.sources.ooxml import scan

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    assert [(r.pos, r.kind, r.text) for r in scan(spark, str(tmp_path / "a.docx")).collect()] == [(0, "p", "one"), (1, "cell", "cell")]


def test_numbering(spark):
    from vellum.operators.numbering import numbering_expand, synthetic_number_scope

    rows = [("f", i, "l", lv, fmt, t, s) for i, (lv, fmt, t, s) in enumerate([(0, "decimal", "%1.", 3.0), (1, "lowerLetter", "%1.%2", None), (1, "lowerLetter", "%1.%2", None), (0, "decimal", "%1.", None), (1, "lowerLetter", "%1.%2", None)])]
    found = numbering_expand(spark.createDataFrame(rows, "f string, pos int, list_id string, level int, format string, template string, start double"), "f")
    assert [r.label for r in found.orderBy("pos").collect()] == ["3.", "3.a", "3.b", "4.", "4.a"]
    rows = [("f", i, z, n) for i, (z, n) in enumerate([("IE", "1"), ("IE", "2"), ("IE", "1"), ("BC", "B62"), ("IE", "IE4")])]
    found = synthetic_number_scope(spark.createDataFrame(rows, "f string, pos int, zone string, number string"), "f")
    assert [r.synthetic_id for r in found.orderBy("pos").collect()] == ["IE사례1-1", "IE사례1-2", "IE사례2-1", "BC-B62", "IE4"]


def test_paragraph_edges(spark):
    from vellum.operators.parse import classified, lines, paragraphs

    text = "dropped\n## S > T\n1. first\n\n  more\n## S > U\n\ntext\n## V\n2. second\n\n"
    rows = classified(lines(spark.createDataFrame([("f", text)], "f string, text string"), "f"), F.col("line").rlike(r"^\d+\.\s"), F.col("line").startswith("## "))
    found = paragraphs(rows, "f", F.expr("substring(line, 4)")).orderBy("seq").collect()
    assert [(r.section_path, r.document) for r in found] == [("S > T", "1. first\n\n  more\nU\ntext"), ("V", "2. second")]


def test_glossary_forms(spark):
    from vellum.operators.glossary import dash_terms, marked_terms, term_levels

    rows = spark.createDataFrame([(1, "(a) Term one – its meaning\n- other - also meaning\n(b) Third. a definition of it\n(c) short – x"), (2, "*alpha:* first *beta*: second")], "k int, document string")
    assert [(r.term, r.definition) for r in dash_terms(rows.where("k = 1"), "k").orderBy("pos").collect()] == [("Term one", "its meaning"), ("other", "also meaning"), ("Third", "a definition of it")]
    assert [(r.term, r.definition) for r in marked_terms(rows.where("k = 2"), "k").orderBy("pos").collect()] == [("alpha", "first"), ("beta", "second")]
    entries = spark.createDataFrame([("power over x", 0, "A"), ("joint power", 1, "B"), ("supercontrol", 2, "C")], "term string, ord int, source_id string")
    asked = spark.createDataFrame([("power",), ("jointpower",), ("control",), ("none",), ("joint power",)], "raw string")
    assert {r.raw: (r.level, r.source_id) for r in term_levels(asked, entries).collect()} == {"power": (3, "A"), "jointpower": (2, "B"), "control": (4, "C"), "joint power": (1, "B")}


def test_incremental(spark, tmp_path):
    from vellum.streaming.incremental import build, current

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "cid string, document string"
    for rows in ([("a", "1"), ("b", "1")], [("b", "2")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        build(spark.readStream.schema(schema).parquet(source), target, "cid", str(tmp_path / "cp")).awaitTermination()
    assert {r.cid: r.document for r in current(spark, target, "cid").collect()} == {"a": "1", "b": "2"}
