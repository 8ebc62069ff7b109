"""Normalising, sources and numbers, against rows made by hand."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(tmp_path, name, body, **parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        for part, xml in parts.items():
            z.writestr(f"word/{part}.xml", f'<w:{part} xmlns:w="{W}">{xml}</w:{part}>')
    (tmp_path / name).write_bytes(data.getvalue())
    return str(tmp_path / name)


def p(text, properties=""):
    return f"<w:p>{f'<w:pPr>{properties}</w:pPr>' if properties else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def lines_of(spark, **files):
    rows = [(f, i, line) for f, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no int, line string")


def written(spark, events):
    from vellum.operators.normalise import emitted

    out = {}
    for r in sorted(emitted(events).collect(), key=lambda r: (r.file, r.pos, r.part)):
        out.setdefault(r.file, []).append(r.line)
    return {f: "\n".join(x).strip("\n") for f, x in out.items()}


def test_front_matter_keeps_the_last_of_a_key(spark):
    from vellum.sources.markdown import annotations, front_matter, lenient_front_matter

    text = "---\na: 1\na: ''2\"\nb: \"\"x\"\"\n---\nbody"
    r = spark.createDataFrame([(text, "<!-- k: 1 | k: 2 | f -->")], "t string, l string").select(front_matter(F.col("t")).alias("f"), lenient_front_matter(F.col("t")).alias("g"), annotations(F.col("l")).alias("a")).first()
    assert r.f.meta == {"a": "''2", "b": "x"} == r.g.meta and r.f.body == r.g.body == "body" and r.a == {"k": "2", "f": "true"}


def test_scan_of_files_and_assertions(spark, tmp_path):
    from vellum.sources.markdown import asserted, files, write_markdown

    for name in ("a.md", "b.md", "README.md"):
        (tmp_path / name).write_text(f"text of {name}")
    found = files(spark, [str(tmp_path)])
    assert sorted((r.source_file, r.text) for r in found.collect()) == [("a.md", "text of a.md"), ("b.md", "text of b.md")]
    kinds = found.withColumn("kind", F.lit("x"))
    assert asserted(kinds, "kind", {"x": 2}, "source_file") is kinds
    with pytest.raises(ValueError, match="x"):
        asserted(kinds, "kind", {"x": 3}, "source_file")
    with pytest.raises(ValueError, match="repeated"):
        asserted(kinds.unionByName(kinds), "kind", {"x": 4}, "source_file")
    write_markdown(spark.createDataFrame([("f", 2, "b"), ("f", 1, "a\n\n\n")], "k string, o int, l string"), str(tmp_path / "out"), "k", "o", "l")
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value.strip() == "a\n\nb"


def test_ooxml_events(spark, tmp_path):
    from vellum.sources.ooxml import literal_number, scan

    body = p("한 2.1 문단의 글") + "<w:p><w:r><w:t>one</w:t><w:cr/><w:t>two</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p/>"
    body += f"<w:tbl><w:tr><w:tc>{p('c1')}{p('c2')}</w:tc><w:tc>{p('31 안')}</w:tc></w:tr></w:tbl>" + p("7 Westferry Circus") + p("B35B 문단의 글")
    notes = f'<w:footnote>{p("n1")}{p("n2")}</w:footnote><w:footnote>{p("m")}</w:footnote>'
    found = scan(spark, docx(tmp_path, "a.docx", body, footnotes=notes)).withColumn("no", literal_number(F.col("kind"), F.col("text"))).orderBy("pos").collect()
    assert [(r.kind, r.text, r.no) for r in found] == [("p", "한 2.1 문단의 글", "한2.1"), ("p", "one two", None), ("cell", "c1", None), ("cell", "c2", None), ("cell", "31 안", None), ("p", "7 Westferry Circus", None), ("p", "B35B 문단의 글", "B35B"), ("note", "n1 n2", None), ("note", "m", None)]


def test_ooxml_numbering_through_styles(spark, tmp_path):
    from vellum.operators.numbering import numbering_expand
    from vellum.sources.ooxml import list_definitions, paragraph_number, scan, split_combined

    num = lambda i, level=0: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{i}"/></w:numPr>'
    lists = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{s}"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, f, t, s in [(0, "decimal", "%1.", 1), (1, "upperLetter", "%1%2)", 26), (2, "lowerRoman", "%3", 1), (3, "bullet", "-", 1)])
    numbering = f'<w:abstractNum w:abstractNumId="7">{lists}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="9"/></w:lvlOverride></w:num>'
    styles = f'<w:style w:styleId="base"><w:pPr>{num(1)}</w:pPr></w:style><w:style w:styleId="child"><w:basedOn w:val="base"/></w:style>'
    style = lambda s: f'<w:pStyle w:val="{s}"/>'
    body = p("감사기준서 200 제목", style("10")) + p("a", style("child")) + "<w:p><w:pPr>" + style("child") + "</w:pPr></w:p>" + p("b", num(1)) + p("c", num(1, 1)) + p("d", num(1, 1)) + p("e", num(1, 2)) + p("f", num(1, 3)) + p("g", num(2)) + p("h", num(1)) + p("i", num(0) + style("child")) + p("감사기준서 210 제목", style("10")) + p("j", num(2))
    rows = scan(spark, path := docx(tmp_path, "n.docx", body, numbering=numbering, styles=styles))
    found = split_combined(numbering_expand(rows, "path", *list_definitions(spark, path))).withColumn("no", paragraph_number(F.col("label"))).orderBy("pos").collect()
    assert [(r.text[-1], r.label) for r in found] == [("목", None), ("a", "1."), ("b", "2."), ("c", "2Z)"), ("d", "2A)"), ("e", None), ("f", None), ("g", "9."), ("h", "10."), ("i", None), ("목", None), ("j", "11.")]
    assert [r.no for r in found if r.no] == ["1", "2", "9", "10", "11"] and [r.standard for r in found] == ["200"] * 10 + ["210"] * 2


def test_two_column_table_and_rebuild(spark, tmp_path):
    from vellum.operators.normalise import isqm_rebuilt
    from vellum.sources.ooxml import scan_table

    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{''.join(map(p, c))}</w:tc>" for c in cells) + "</w:tr>"
    table = row(["Part"]) + row(["1"], ["first", "more"]) + row([""], ["short"]) + row([""], ["long " * 12]) + row(["2"], ["12. second"])
    found = scan_table(spark, docx(tmp_path, "t.docx", f"<w:tbl>{row(['x'], ['y'])}</w:tbl><w:tbl>{table}</w:tbl>"))
    assert [(r.kind, r.number, r.text) for r in found.orderBy("pos").collect()] == [("section", None, "Part"), ("para", "1", "first"), ("cont", None, "\tmore"), ("section", None, "short"), ("cont", None, ("long " * 12).strip()), ("para", "2", "12. second")]
    text = written(spark, isqm_rebuilt(found.withColumnRenamed("path", "file"), "Scope"))
    assert list(text.values()) == ["## Part\n\n1.\tfirst\n\tmore\n\n## short\n" + ("long " * 12).strip() + "\n\n2.\t12. second"]


def test_emitter_defers_and_indents(spark):
    from vellum.operators.normalise import rendered, emitted

    rows = [(0, "section", None, "A"), (1, "section", None, "B"), (2, "para", "31", "text  "), (3, "cont", None, "12. looks like a head"), (4, "section", None, "B"), (5, "cont", None, "plain"), (6, "section", None, "C")]
    events = spark.createDataFrame([("f", *r) for r in rows], "file string, pos int, kind string, number string, text string")
    assert written(spark, events) == {"f": "## B\n\n31.\ttext\n\t12. looks like a head\nplain"}
    meta = spark.createDataFrame([("f", 1, "standard_no", "200"), ("f", 0, "source_type", "x")], "file string, ord int, key string, value string")
    assert rendered(emitted(events), meta).first().text == '---\nsource_type: x\nstandard_no: "200"\n---\n\n## B\n\n31.\ttext\n\t12. looks like a head\nplain\n'


def test_promotion_by_series(spark):
    from vellum.operators.normalise import promoted

    rows = [("A1\tstarts", None), ("A2 goes on", None), ("B7 does not", None), ("text", None), ("sure", "B6"), ("B7 now does", None), ("31", "31"), ("B8 broken off", None), ("B1 starts", None)]
    frame = spark.createDataFrame([("f", i, line, n, n is None) for i, (line, n) in enumerate(rows)], "file string, line_no int, line string, number string, candidate boolean")
    assert [r.promoted for r in promoted(frame).orderBy("line_no").collect()] == ["A1", "A2", None, None, None, "B7", None, None, "B1"]


def test_appendix_numbers(spark):
    from vellum.operators.normalise import appendix_numbers

    o, n = {"opens": True}, {"numbered": True}
    rows = [("before", {}), ("Appendix", o), ("intro", {}), ("사례 2 - too early", {}), ("사례 1 - first", {}), ("사례 2: second", {}), ("List", o | {"reference": True}), ("refs", {}), ("Lone", o | {"single_case": True}), ("the case", {}), ("사례 3 goes by", {}), ("사례 4", {}), ("Numbered", o), ("1. real", n), ("rest", {})]
    frame = spark.createDataFrame([("f", i, t, *(k.get(c, False) for c in ("opens", "reference", "single_case", "numbered"))) for i, (t, k) in enumerate(rows)], "file string, line_no int, line string, opens boolean, reference boolean, single_case boolean, numbered boolean")
    assert {r.line: r.virtual for r in appendix_numbers(frame).collect() if r.virtual} == {"intro": "부록1", "사례 1 - first": "부록-사례1", "사례 2: second": "부록-사례2", "refs": "참조1", "the case": "부록-사례3", "사례 4": "부록-사례4"}


def test_wrapped_terms(spark):
    from vellum.operators.normalise import glossary_rows, wrapped

    text = "| 용어 | 정의 |\n|---|---|\n| 보험계약 | one |\n| 포트폴리오 | two |\n| | three |\n| **other** | four |"
    rows = glossary_rows(lines_of(spark, f=text)).withColumn("standard_no", F.lit("1117"))
    wraps = spark.createDataFrame([("1117", "포트폴리오", "보험계약")], "standard_no string, fragment string, previous string")
    assert [(r.number, r.term, r.definition) for r in wrapped(rows, wraps).orderBy("line_no").collect()] == [("정의-보험계약포트폴리오", "보험계약 포트폴리오", "one\n\ttwo\n\tthree"), ("정의-other", "other", "four")]


def test_synthetic_numbers_of_every_kind(spark):
    from vellum.operators.numbering import synthetic_number_scope

    rows = [("IE", "CU100", None), ("IE", None, None), ("IE", "A1", None), ("IE", "1", "부록 C"), ("IE", "1", "사례 7"), ("IE", "1.2", "사례 7"), ("IE", "1", "사례 7"), ("IE", "x", "사례 7"), ("BC", "4", "사례 7"), ("BC", "?", "사례 7"), ("IE", "IG3", "사례 7")]
    frame = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "f string, pos int, zone string, number string, section string")
    assert [r.synthetic_id for r in synthetic_number_scope(frame, "f").orderBy("pos").collect()] == [None, None, "IE부록A-1", "IE부록C-1", "IE사례7-1", "IE사례7-1.2", "IE사례8-1", None, "BC-4", None, "IG3"]


def test_text_functions(spark):
    from vellum.functions import text as T

    shift = 0x912A
    low, high = 0xAC00 - shift, 0xD7A3 - shift
    hidden = "".join(chr(ord(c) - shift) for c in "가나")
    cases = [hidden[0] + "abcd", "  " + hidden + "abcd  ", "abcdef" + hidden[0], "", None, "   "]
    found = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", T.restore_shifted(shift, low, high)(F.col("c")).alias("r")).orderBy("i").collect()
    assert [r.r for r in found] == ["가abcd", "  가나abcd  ", "abcdef" + hidden[0], "", None, "   "]
    forms = ["IE사례12A-3.1", "IE부록B-12", "BC부록A-1", "BC-B62", "BC62", "BC-" + "x" * 20_000]
    numbers = [r[0] for r in spark.createDataFrame([(c,) for c in forms], "c string").select(T.original_number(F.col("c"))).collect()]
    assert numbers == ["3.1", "B12", "A1", "B62", None, "x" * 20_000]
    norms = ["․ㆍ “가”—나: [다]", "ｶﾞ  １", "녂{x}"]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in norms], "c string").select(T.audit_norm(F.col("c"))).collect()] == ["·ᆞ가-나다", "ガ1", "x"]
    md = ["| --- | :-- |", "| **가** | 나[^3]<br>다 |", "- (a) 본문 [각주: 말] 끝", "부록-(b). 항목", "(ⅳ) 넷", "a (b) c"]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in md], "c string").select(T.markdown_norm(F.col("c"))).collect()] == ["", "가나다", "본문끝", "항목", "넷", "a(b)c"]
    r = spark.createDataFrame([("KSA::240::A1#2", "A > B > C", "Abc", "가A", [3.0, 4.0], [0.6, 0.8])], "cid string, s string, x string, y string, v array<double>, u array<double>")
    r = r.select(T.logical_id(F.col("cid")).alias("l"), T.cid_parts(F.lit("KSA::240::A1")).alias("p"), T.cid_parts(F.lit("a::b")).alias("q"), T.last_segment(F.col("s")).alias("e"), T.lower_latin(F.col("x")).alias("x"), T.lower_latin(F.col("y")).alias("y"), T.l2_normalise(F.col("v")).alias("v"), T.l2_normalise(F.col("u")).alias("u")).first()
    assert (r.l, tuple(r.p), r.q, r.e, r.x, r.y, r.v, r.u) == ("KSA::240::A1", ("KSA", "240", "A1"), None, "C", "abc", "가A", [0.6, 0.8], [0.6, 0.8])


def test_json_reports_and_metadata(spark, tmp_path):
    from vellum.sources import files

    (tmp_path / "g.json").write_text(json.dumps([{"term": "a", "ord": 1}, {"term": "b", "ord": 2}], indent=1))
    (tmp_path / "v.json").write_text(json.dumps({"meta": {"k1": 1.5}, "tokens": {"x": 0, "y": 1}}))
    assert [(r.term, r.ord) for r in files.read_json(spark, str(tmp_path / "g.json")).orderBy("ord").collect()] == [("a", 1), ("b", 2)]
    vocabulary = files.read_map(spark, str(tmp_path / "v.json"), "tokens")
    assert {r.key: r.value for r in vocabulary.collect()} == {"x": 0, "y": 1}
    rows = spark.createDataFrame([("c1", None), ("c2", "t")], "cid string, text string")
    files.write_jsonl(rows, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "out"), "cid string, text string").collect()) == [("c1", None), ("c2", "t")]
    files.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "o int, l string"), str(tmp_path / "report"), "o", "l")
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a", "b"]
    manifest = spark.createDataFrame([(1,)], "points int")
    for _ in range(2):
        assert files.write_metadata(str(tmp_path / "meta"), manifest, vocabulary, rows) == {"manifest": 1, "vocabulary": 2, "glossary": 2}
    with pytest.raises(ValueError, match="manifest"):
        files.write_metadata(str(tmp_path / "meta"), manifest.limit(0), vocabulary, rows)
    for _ in range(2):
        files.create_collection(spark, "vellum_points", "composite_id string, source_type string, standard_no string", str(tmp_path / "points"), 2)
    assert spark.table("vellum_points").isEmpty()
    spark.sql("drop table vellum_points")


def test_compaction_of_an_incremental_build(spark, tmp_path):
    from vellum.streaming.incremental import compact, current, upsert

    for epoch, rows in enumerate([[("a", "1"), ("b", "1"), ("b", "0")], [("b", "2")]]):
        upsert(spark, str(tmp_path / "t"), spark.createDataFrame(rows, "cid string, document string"), "cid", epoch)
    assert {r.cid: r.document for r in current(spark, str(tmp_path / "t"), "cid").collect()} == {"a": "1", "b": "2"}
    assert compact(spark, str(tmp_path / "t"), "cid", str(tmp_path / "u")).count() == 2
    upsert(spark, str(tmp_path / "u"), spark.createDataFrame([("a", "3")], "cid string, document string"), "cid", 2)
    assert {r.cid: r.document for r in current(spark, str(tmp_path / "u"), "cid").collect()} == {"a": "3", "b": "2"}
