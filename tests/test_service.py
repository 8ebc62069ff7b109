"""The search service on a small corpus made by hand: policy, lookups, definitions, checks, the contract."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

ROWS = [
    # cid, kind, standard, number, type, section, seq, document, part
    ("KIFRS::1115::31", "회계기준", "1115", "31", "본문", "A > B", 1, "revenue is recognised when control passes", None),
    ("KIFRS::1115::IE2", "회계기준", "1115", "IE2", "적용사례", "A > C", 2, "example of revenue and control", None),
    ("KIFRS::1115::BC4", "회계기준", "1115", "BC4", "결론도출근거", "A > D", 3, "why revenue needs control", None),
    ("KIFRS::CF::4.1", "회계기준", "CF", "4.1", "본문", "E", 1, "framework of revenue", None),
    ("KSA::240::부록1#1", "감사기준", "240", "부록1", "부록", "F", 1, "fraud and revenue first half", 1),
    ("KSA::240::부록1#2", "감사기준", "240", "부록1", "부록", "F", 1, "fraud and revenue second half", 2),
    ("KSA::240::참조1", "감사기준", "240", "참조1", "참조", "F", 2, "list of revenue references", None),
    ("KSA::200::13", "감사기준", "200", "13", "요구사항", "G > 정의", 1, "revenue (term) zzz", None),
]
FILES = {"1115": "k1115.md", "CF": "cf.md", "240": "ksa240.md", "200": "ksa200.md"}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    from vellum.operators.index import build

    rows = [(i, *r[:8], FILES[r[2]], f"title {r[2]}", r[8], None if r[8] is None else 2) for i, r in enumerate(ROWS)]
    points = spark.createDataFrame(rows, "point long, composite_id string, source_type string, standard_no string, para_no string, para_type string, section_path string, seq long, document string, source_file string, standard_title string, part_no long, part_total long")
    return build(points, str(tmp_path_factory.mktemp("index")), "point", "document", buckets=4, contract={"dim": 2})


def ask(spark, made, query="revenue control", **given):
    from vellum.operators.service import search_points

    kinds = {"standard_no": "array<string>", "source_type": "array<string>", "para_type": "string", "top_k": "int", "include_examples": "boolean", "include_bc": "boolean", "include_framework": "boolean"}
    request = spark.createDataFrame([(1, query, *(given.get(k) for k in kinds))], "qid int, query string, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))
    vectors = made.points.select("point", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    results, applied, checked = search_points(made, request, spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vec array<double>"), vectors)
    return sorted(results.collect(), key=lambda r: r.rank), applied.first(), checked.first().error


def test_opt_outs_hide_and_count(spark, made):
    results, applied, _ = ask(spark, made)
    assert {r.cid for r in results} == {"KIFRS::1115::31", "KSA::240::참조1", "KSA::200::13"} and results[0].cid == "KIFRS::1115::31"
    assert (applied.examples_excluded, applied.bc_excluded, applied.framework_excluded) == (3, 1, 1) and len(applied.notes) == 3
    results, applied, _ = ask(spark, made, include_examples=True, include_bc=True, include_framework=True)
    assert len(results) == 7 and (applied.examples_excluded, applied.bc_excluded, applied.framework_excluded, applied.notes) == (0, 0, 0, [])
    whole = next(r for r in results if r.cid == "KSA::240::부록1")
    assert whole.text == "fraud and revenue first half\nfraud and revenue second half" and whole.notes == ["분할 문단 2조각 재조립"]
    assert next(r for r in results if r.para_type == "참조").notes == ["발췌 대조표 — 원전 문단 우선 인용"]


def test_explicit_filters_override(spark, made):
    results, applied, _ = ask(spark, made, para_type="적용사례")
    assert [r.cid for r in results] == ["KIFRS::1115::IE2"] and applied.notes == ["para_type: over the opt-out"] and applied.filters.para_type == "적용사례"
    results, applied, _ = ask(spark, made, standard_no=["CF", "200"])
    assert {r.cid for r in results} == {"KIFRS::CF::4.1", "KSA::200::13"} and "standard_no: over the opt-out" in applied.notes and applied.framework_excluded == 0
    results, applied, _ = ask(spark, made, source_type=["감사기준"], top_k=1)
    assert len(results) == 1 and applied.filters.source_type == ["감사기준"] and applied.filters.standard_no is None


def test_unknown_tokens_and_bad_arguments(spark, made):
    results, applied, _ = ask(spark, made, "qqq Www qqq")
    assert results and applied.oov_query_tokens == ["qqq", "www"] and applied.notes[0] == "dense only: no known token"
    assert ask(spark, made, "zz revenue aa")[1].oov_query_tokens == ["zz", "aa"]
    for query, given in (("", {}), ("x" * 501, {}), (None, {}), ("x", {"top_k": 0}), ("x", {"top_k": 21}), ("x", {"source_type": ["other"]}), ("x", {"para_type": "other"})):
        results, applied, error = ask(spark, made, query, **given)
        assert not results and applied is None and error.code == "INVALID_INPUT" and error.hint


def test_get_paragraph(spark, made):
    from vellum.operators.service import get_paragraph

    asked = [(0, "KIFRS::1115::31", 2), (1, "KSA::240::부록1", 0), (2, "KSA::240::부록1#1", 0), (3, "KSA::240", 0), (4, "XX::1::2", 0), (5, "KSA::1::2", 0), (6, "KIFRS::1115::31", 4), (7, None, 0), (8, "KSA::240::참조1", 1), (9, "KIFRS::1115::31", None)]
    found = {r.rid: r for r in get_paragraph(spark.createDataFrame(asked, "rid int, cid string, context int"), made.points).collect()}
    assert [(p.cid, p.is_context) for p in found[0].paragraphs] == [("KIFRS::1115::31", False), ("KIFRS::1115::IE2", True), ("KIFRS::1115::BC4", True)]
    assert found[1].paragraphs[0].text.count("\n") == 1 and found[1].notes == ["분할 문단 2조각 재조립"]
    assert [(p.cid, p.is_context) for p in found[8].paragraphs] == [("KSA::240::부록1", True), ("KSA::240::참조1", False)] and found[8].notes == ["KSA::240::부록1: 분할 문단 2조각 재조립"]
    assert {i: found[i].error.code for i in range(10) if found[i].error} == {2: "INVALID_INPUT", 3: "INVALID_INPUT", 4: "INVALID_INPUT", 5: "NOT_FOUND", 6: "INVALID_INPUT", 7: "INVALID_INPUT", 9: "INVALID_INPUT"}
    assert all(r.found == (r.error is None) == (r.paragraphs is not None) for r in found.values())


ENTRIES = [("control", 0, "def a", "KIFRS::1115::정의-control", "1115"), ("control", 1, "def b", "KSA::240::A1", "240"), ("joint control", 2, "def c", "KIFRS::1111::정의-jointcontrol", "1111"), ("revenue", 3, "def d", "KIFRS::1115::31", "1115"), ("passes", 4, "def e", "KSA::240::A9", "240")]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "term string, ord int, definition string, source_id string, standard_no string")


def test_definitions_beside_results(spark):
    from vellum.operators.service import injected_definitions

    results = spark.createDataFrame([(q, 1, "KIFRS::1115::31", "1115", "revenue passes revenue") for q in (1, 2)] + [(2, 2, "x", "240", "control")], "qid int, rank long, cid string, standard_no string, text string")
    asked = spark.createDataFrame([(1, "what is joint control", None), (2, "nothing", ["240"])], "qid int, query string, standard_no array<string>")
    found = {(r.qid, r.pos): (r.term, r.source_cid) for r in injected_definitions(asked, results, entries(spark)).collect()}
    # asked for: the longest term alone; out of the results: passes, but not revenue, whose entry is a result; the filtered standard picks
    assert found == {(1, 1): ("joint control", "KIFRS::1111::정의-jointcontrol"), (1, 2): ("passes", "KSA::240::A9"), (2, 1): ("control", "KSA::240::A1"), (2, 2): ("passes", "KSA::240::A9")}


def test_define_terms(spark):
    from vellum.operators.service import define_terms

    asked = [(0, ["control", "jointcontrol", "zz"], "240"), (1, [], None), (2, ["a"] * 11, None), (3, ["control"], None)]
    found = {(r.rid, r.pos): r for r in define_terms(spark.createDataFrame(asked, "rid int, terms array<string>, context_standard string"), entries(spark)).collect()}
    assert (found[0, 0].source_cid, [a.source_cid for a in found[0, 0].alternates]) == ("KSA::240::A1", ["KIFRS::1115::정의-control"])
    assert found[0, 1].matched == "joint control" and found[0, 2].matched is None and found[0, 2].error is None
    assert found[1, None].error.code == found[2, None].error.code == "INVALID_INPUT" and found[3, 0].text == "def a"


def test_glossary_of_a_corpus(spark):
    from vellum.operators.glossary import extracted

    rows = [("a", "1115", "회계기준", "정의", "x", "　용어\t: 뜻\n"), ("b", "1115", "회계기준", "본문", "A > 용어의 정의 (문단 3)", "*갑*: 하나 *을:* 둘"), ("c", "240", "감사기준", "요구사항", "정의", "(a) 항목 – 그 뜻은 이것\n• 다른 것 - 이 또한 뜻"), ("d", "320", "감사기준", "요구사항", "정의", "이 기준서에서 사용하는 중요성이란 것"), ("e", "1115", "회계기준", "결론도출근거", "정의", "*병*: 셋"), ("f", "240", "감사기준", "요구사항", "범위", "(a) 항목 – 뜻이 아님")]
    records = spark.createDataFrame(rows, "composite_id string, standard_no string, source_type string, para_type string, section_path string, document string")
    found = sorted((r.source_id, r.pos, r.term, r.definition, r.form) for r in extracted(records).collect())
    assert found == [("a", 0, "용어", "뜻", "paragraph"), ("b", 0, "갑", "하나", "marked"), ("b", 1, "을", "둘", "marked"), ("c", 0, "항목", "그 뜻은 이것", "line"), ("c", 1, "다른 것", "이 또한 뜻", "line"), ("d", 0, "중요성", "이 기준서에서 사용하는 중요성이란 것", "prose")]


def test_index_is_read_by_bucket_and_opens_again(spark, made):
    from vellum.operators import search
    from vellum.operators.index import SearchIndex

    again = SearchIndex(spark, made.path)
    assert again.manifest == made.manifest and again.manifest["points"] == 8 and again.manifest["dim"] == 2
    toks = spark.createDataFrame([(1, "revenue")], "qid int, tok string")
    scores = again.sparse_scores(toks, "qid")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:60]
    assert scores.count() == 8 and search.lengths(search.tokens(again.points, "point", "document"), "point").count() == 8


def test_contract_refuses(spark):
    from vellum.operators import checks

    expected = {"sparse.k1": 1.5, "sparse.tokenizer_version": "0.23.2", "collection.points": 8}
    assert checks.enforce(expected, expected | {"other": 1}) == []
    warned = checks.enforce(expected, expected | {"sparse.tokenizer_version": "0.23.9"})
    assert [w["item"] for w in warned] == ["sparse.tokenizer_version"]
    with pytest.raises(checks.ContractMismatch, match="sparse.k1") as refused:
        checks.enforce(expected, expected | {"sparse.k1": 9.9})
    assert refused.value.hint and refused.value.actual == 9.9
    with pytest.raises(checks.ContractMismatch, match="version"):
        checks.enforce(expected, expected | {"sparse.tokenizer_version": "0.24.0"})
    checks.probe_encoder(lambda t: [0.6, 0.8], 2)
    for vector in ([0.6], [3.0, 4.0], [float("nan"), 0.0]):
        with pytest.raises(checks.ContractMismatch):
            checks.probe_encoder(lambda t: vector, 2)  # noqa: B023
    a, b = (spark.createDataFrame([(k,) for k in x], "cid string") for x in ("ab", "ac"))
    with pytest.raises(ValueError):
        checks.joined_by_key(a, b, "cid")
    assert checks.joined_by_key(a, a.withColumn("v", F.lit(1)), "cid").count() == 2
    assert {(r.k, r.want, r.have) for r in checks.drift(spark.createDataFrame([("x",), ("x",)], "k string"), "k", {"x": 1, "y": 2}).collect()} == {("x", 1, 2), ("y", 2, 0)}


def test_validation_finds_each_violation(spark):
    from vellum.operators import checks
    from vellum.operators.normalise import HEAD, NO_PERIOD

    text = {"a": "1.\tone\n2.\ttwo\n2.\tagain\n5.\tfive <!-- x -->\n## 보론 1\nacross\nA7 no period\n부록1.\tpiece", "b": "1.\tshort\nA1.\t" + "x" * 6001, "g": "BC1.\tz"}
    lines = spark.createDataFrame([(f, i, x) for f, t in text.items() for i, x in enumerate(t.split("\n"))], "file string, line_no int, line string")
    standard = spark.createDataFrame([("a", "S"), ("b", "S"), ("g", "T")], "file string, standard_no string")
    expected = spark.createDataFrame([("a", i, n) for i, n in enumerate(["1", "2", "2", "5", "부록2", "부록1"], 1)] + [("b", 1, "1"), ("b", 2, "참조1"), ("g", 1, "BC1")], "file string, pos int, para_no string")
    galleys = spark.createDataFrame([("g", 2), ("h", 1)], "file string, n int")
    found = {(r.file, r.check) for r in checks.validation(lines, HEAD, NO_PERIOD, standard, expected=expected, galleys=galleys).collect()}
    assert found == {
        ("a", "repeated number"), ("a", "comment left"), ("a", "head without a period"), ("a", "numbers left out"), ("a", "paragraph across a section"), ("a", "number in several files"), ("a", "cut pieces differ"), ("a", "sequence differs"),
        ("b", "paragraph too long"), ("b", "sequence differs"), ("b", "references differ"), ("b", "cut pieces differ"), ("g", "galley size differs"), ("h", "galley missing"), ("h", "galley size differs"),
    }
    allowed = spark.createDataFrame([("a", 2)], "file string, after long"), spark.createDataFrame([("b", "A1")], "file string, para_no string")
    left = {(r.file, r.check) for r in checks.validation(lines, HEAD, NO_PERIOD, standard, *allowed).collect()}
    assert ("a", "numbers left out") not in left and ("b", "paragraph too long") not in left


def test_audit_finds_mutations(spark):
    from vellum.operators import evaluation

    words = " ".join(f"w{i}" for i in range(4000))
    pages = spark.createDataFrame([(1, i, words[i : i + 700]) for i in range(0, len(words), 700)], "scope int, page int, t string")
    joined = " ".join(words[i : i + 700] for i in range(0, len(words), 700))
    lines = spark.createDataFrame([(k, 1, n, joined[1000 * k + 90 * n : 1000 * k + 90 * n + 80]) for k in range(12) for n in range(3)] + [(99, 1, 0, "")], "para int, scope int, line_no int, line string")
    sound = evaluation.containment(lines, pages, "para", "scope", "page", "t")
    assert {r.bucket for r in sound.collect()} == {"OK"} and sound.count() == 13
    broken = evaluation.containment(evaluation.mutated(lines, "para", F.col("para").isin(2, 5, 7)), pages, "para", "scope", "page", "t")
    assert {r.para for r in broken.collect() if r.bucket != "OK"} == {2, 5, 7}
    counts = evaluation.bucket_counts(broken.withColumn("scope", F.lit(1)), "scope")
    assert [(r.n, r.ok, r.partial + r.missing) for r in evaluation.worst(counts, "scope").collect()] == [(13, 10, 3)]
    assert evaluation.worst(evaluation.bucket_counts(sound.withColumn("scope", F.lit(1)), "scope"), "scope").isEmpty()


def test_segments_hold_all_short_strings(spark):
    from vellum.operators.evaluation import segments

    texts = ["abcdefg", "", "hij", "k" * 30, "lmnop"]
    found = segments(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "s int, o int, t string"), "s", "o", "t", 6, 10).collect()
    whole = " ".join(texts)
    assert all(r.stream in whole and len(r.stream) <= 16 for r in found)
    assert all(any(whole[i : i + n] in r.stream for r in found) for n in range(1, 7) for i in range(len(whole) - n + 1))


def test_library_without_the_training_operators():
    """With that subpackage absent the rest imports, and registers the same queries."""
    code = "import sys; sys.modules['vellum.llm'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'rrf_hybrid_topk' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_contained_strings(spark):
    """Every string in every text, short and long, by scope and without, against Python."""
    import random

    from vellum.operators.containment import contained

    rng = random.Random(2)
    texts = [(i, i % 2, "".join(rng.choice("ab é") for _ in range(n))) for i, n in enumerate([0, 5, 22, 23, 24, 60, 300, 300, 2000])] + [(9, 1, None), (10, 0, "a" * 500)]
    cuts = [(t, t[a : a + n]) for _, _, t in texts if t for n in (1, 7, 22, 23, 24, 40, 290) for a in [rng.randrange(max(1, len(t) - n))] if len(t) >= n]
    strings = sorted({(s, k) for _, s in cuts for k in (0, 1)} | {("zz", 0), ("a" * 100, 0), ("x" * 50, 1)})
    left, right = spark.createDataFrame(texts, "k int, scope int, t string"), spark.createDataFrame(strings, "s string, scope int")
    found = {(r.k, r.s) for r in contained(left, ["k"], "t", right, "s", ["scope"]).collect()}
    assert found == {(k, s) for k, g, t in texts if t for s, h in strings if g == h and s in t}
    whole = {(r.k, r.s) for r in contained(left, ["k"], "t", right.select("s").distinct(), "s").collect()}
    assert whole == {(k, s) for k, _, t in texts if t for s, _ in strings if s in t}


def test_external_vectors(spark):
    from vellum.operators import checks

    records = spark.createDataFrame([("a",), ("b",)], "cid string")
    vectors = lambda *v: spark.createDataFrame([(k, x) for k, x in zip("abc", v)], "cid string, v array<double>")
    found, warnings = checks.external_vectors(records, vectors([3.0, 4.0], [0.6, 0.8]), "cid", "v", 2)
    assert {r.cid: [round(x, 9) for x in r.v] for r in found.collect()} == {"a": [0.6, 0.8], "b": [0.6, 0.8]} and len(warnings) == 1
    for wrong in (vectors([1.0], [0.6, 0.8]), vectors([float("nan"), 1.0], [0.6, 0.8]), vectors([1.0, 0.0]), vectors([1.0, 0.0], [1.0, 0.0], [1.0, 0.0])):
        with pytest.raises(ValueError):
            checks.external_vectors(records, wrong, "cid", "v", 2)
    tokens = spark.createDataFrame([("a", "x")] * 3 + [("b", "x")], "cid string, tok string")
    checks.refuse_over_limit(tokens, "cid", 3)
    with pytest.raises(ValueError, match="'a', 3"):
        checks.refuse_over_limit(tokens, "cid", 2)


def test_own_tokenizer_and_encoder(spark, tmp_path):
    from vellum.operators import search
    from vellum.operators.index import build

    def letters(rows, key, text="text"):
        return rows.select(key, F.posexplode(F.split(F.col(text), "")).alias("pos", "tok"))

    made = build(spark.createDataFrame([(1, "abca"), (2, "bd")], "k int, text string"), str(tmp_path / "i"), "k", "text", letters)
    asked = spark.createDataFrame([(7, "axbx")], "q int, text string")
    assert sorted(r.tok for r in made.tokens(asked, "q", "text").collect()) == ["a", "b", "x"]
    assert made.out_of_vocabulary(made.tokenizer(asked, "q", "text"), "q").first().oov == ["x"]
    assert {r.k for r in made.sparse_scores(made.tokens(asked, "q", "text"), "q").collect()} == {1, 2} and made.manifest["avgdl"] == 3.0
    found = search.encoded(asked, "q", "text", lambda texts: [[len(t), 0.5] for t in texts]).first()
    assert found.vec == [4.0, 0.5]


def test_whole_responses(spark, made):
    from vellum.operators.service import search_responses

    request = spark.createDataFrame([(1, "joint control of revenue", None, None, None, 2, None, None, None), (2, "", None, None, None, None, None, None, None)], "qid int, query string, standard_no array<string>, source_type array<string>, para_type string, top_k int, include_examples boolean, include_bc boolean, include_framework boolean")
    vectors = made.points.select("point", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    found = {r.qid: r for r in search_responses(made, request, spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vec array<double>"), vectors, entries(spark)).collect()}
    assert [r.rank for r in found[1].results] == [1, 2] and found[1].definitions[0].term == "joint control" and found[1].applied.bc_excluded >= 0 and found[1].error is None
    assert found[2].error.code == "INVALID_INPUT" and found[2].results is None and found[2].definitions is None and found[2].applied is None
