"""The three public operations over a built index, for a whole table of requests at once.

get_paragraph looks a paragraph up by its composite id, search answers queries under the opt-out policy, and
define_terms resolves terms. A request that is not valid gets an error envelope and no answer.

Points are paragraphs or parts of them: composite_id, source_type, standard_no, standard_title, para_no, para_type,
section_path, seq, source_file, document, and part_no, part_total for parts (`...#n`), null for whole paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import cid_parts, dot, gloss_norm, logical_id
from vellum.operators import glossary, search
from vellum.operators.index import SearchIndex

#: Codes and kinds of sources, kinds of paragraphs, what each axis of the opt-out policy hides, notes.
SOURCE_TYPES = {"KSA": "감사기준", "KIFRS": "회계기준", "GUIDE": "실무지침"}
PARA_TYPES = ["정의", "참조", "부록", "요구사항", "적용지침", "본문", "결론도출근거", "적용사례"]
EXAMPLE_TYPES, BC_TYPES, FRAMEWORK_NOS = ["부록", "적용사례"], ["결론도출근거"], ["CF", "MC", "PS2"]
REFERENCE_TYPE, REFERENCE_NOTE = "참조", "발췌 대조표 — 원전 문단 우선 인용"
REASSEMBLED = ("분할 문단 ", "조각 재조립")
DEDICATED = "::정의-"
MAX_QUERY, MAX_TOP, MAX_CONTEXT, MAX_TERMS, MAX_DEFINITIONS = 500, 20, 3, 10, 5

ERROR = "struct<code: string, message: string, hint: string>"


def error(code: str, message: Column, hint: str) -> Column:
    return F.struct(F.lit(code).alias("code"), message.cast("string").alias("message"), F.lit(hint).alias("hint"))


def first_error(*cases: tuple[Column, Column]) -> Column:
    """The envelope of the first case that holds, or null."""
    found = F.lit(None).cast(ERROR)
    for holds, envelope in reversed(cases):
        found = F.when(F.coalesce(holds, F.lit(False)), envelope).otherwise(found)
    return found


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


# ---- paragraphs


def reassembled_points(points: DataFrame) -> DataFrame:
    """One row for each logical paragraph: cid, its payload, its text (parts in order, joined by a line feed), n_parts."""
    payload = ["source_type", "standard_no", "standard_title", "para_no", "para_type", "section_path", "seq", "source_file"]
    part = F.struct(F.coalesce("part_no", F.lit(0)).alias("part_no"), "document")
    found = points.withColumn("cid", logical_id(F.col("composite_id"))).groupBy("cid").agg(*(F.min(c).alias(c) for c in payload), F.array_sort(F.collect_list(part)).alias("_parts"))
    return found.withColumn("text", F.array_join(F.transform("_parts", lambda p: p["document"]), "\n")).withColumn("n_parts", F.size("_parts").cast("long")).drop("_parts")


def reassembly_note(n_parts: Column) -> Column:
    return F.when(n_parts > 1, F.concat(F.lit(REASSEMBLED[0]), n_parts.cast("string"), F.lit(REASSEMBLED[1])))


def get_paragraph(requests: DataFrame, points: DataFrame) -> DataFrame:
    """requests: rid, cid, context -> rid, error, found, paragraphs (in order of seq), notes.

    Neighbours are of the same source file, within `context` of the paragraph's seq, found among narrow rows; then only the texts of what is shown are put together.
    """
    parts = cid_parts(F.col("cid"))
    bad_shape = parts.isNull() | ~F.coalesce(parts["code"].isin(list(SOURCE_TYPES)), F.lit(False))
    wrong = first_error(
        (F.col("cid").isNull() | (F.instr("cid", "#") > 0), error("INVALID_INPUT", F.concat(F.lit("a part's id: "), F.coalesce("cid", F.lit("null"))), "use what stands before '#'")),
        (bad_shape, error("INVALID_INPUT", F.concat(F.lit("not a composite id: "), F.col("cid")), "CODE::standard::paragraph, CODE one of KSA, KIFRS, GUIDE")),
        (F.col("context").isNull() | ~F.col("context").between(0, MAX_CONTEXT), error("INVALID_INPUT", F.concat(F.lit("context="), F.coalesce(F.col("context").cast("string"), F.lit("null"))), "0 to 3")),
    )
    asked = requests.select("rid", "cid", F.col("context").cast("long").alias("context"), wrong.alias("error"))
    good = asked.where("error is null")
    keyed = points.withColumn("cid", logical_id(F.col("composite_id")))
    narrow = keyed.select("cid", "source_file", "seq").distinct()
    hit = good.join(narrow, "cid")
    near = hit.where("context > 0").select("rid", "source_file", F.col("cid").alias("_own"), F.explode(F.sequence(F.col("seq") - F.col("context"), F.col("seq") + F.col("context"))).alias("seq"))
    near = near.join(narrow, ["source_file", "seq"]).where("cid <> _own").select("rid", "cid", F.lit(True).alias("is_context"))
    wanted = hit.select("rid", "cid", F.lit(False).alias("is_context")).unionByName(near)
    whole = reassembled_points(keyed.join(wanted.select("cid").distinct(), "cid", "left_semi"))  # texts of these alone
    rows = wanted.join(whole, "cid")
    shown = F.struct("seq", "cid", "source_type", "standard_no", "standard_title", "para_no", "para_type", "section_path", "text", "is_context")
    note = reassembly_note(F.col("n_parts"))
    told = F.when(F.col("is_context"), F.concat("cid", F.lit(": "), note)).otherwise(note)
    answers = rows.groupBy("rid").agg(F.array_sort(F.collect_list(shown)).alias("paragraphs"), F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("is_context", "seq", told.alias("note"))))).alias("_notes"))
    answers = answers.select("rid", "paragraphs", F.transform("_notes", lambda n: n["note"]).alias("notes"))
    found = asked.join(answers, "rid", "left")
    missing = error("NOT_FOUND", F.concat(F.lit("no paragraph "), F.col("cid")), "use search")
    return found.select("rid", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("paragraphs").isNull(), missing).alias("error"), F.col("paragraphs").isNotNull().alias("found"), "paragraphs", "notes")


# ---- search


def policy(requests: DataFrame) -> DataFrame:
    """requests: qid, query, standard_no and source_type (arrays), para_type, top_k, include_examples, include_bc, include_framework.

    Adds error, hide_types, hide_standards (what the opt-outs hide; an explicit type or standard overrides them) and override notes.
    """
    query, length = F.col("query"), F.length(F.coalesce("query", F.lit("")))
    top_k = F.coalesce(F.col("top_k").cast("long"), F.lit(8).cast("long"))
    unknown = F.filter("source_type", lambda x: ~F.coalesce(x.isin(list(SOURCE_TYPES.values())), F.lit(False)))
    wrong = first_error(
        (query.isNull() | ~length.between(1, MAX_QUERY), error("INVALID_INPUT", F.concat(F.lit("query of length "), length.cast("string")), "1 to 500 characters")),
        (~top_k.between(1, MAX_TOP), error("INVALID_INPUT", F.concat(F.lit("top_k="), top_k.cast("string")), "1 to 20")),
        (F.size(F.coalesce(unknown, strings([]))) > 0, error("INVALID_INPUT", F.concat(F.lit("source_type "), F.array_join(unknown, ", ")), ", ".join(SOURCE_TYPES.values()))),
        (F.col("para_type").isNotNull() & ~F.col("para_type").isin(PARA_TYPES), error("INVALID_INPUT", F.concat(F.lit("para_type "), F.col("para_type")), ", ".join(PARA_TYPES))),
    )
    shown = lambda c: F.coalesce(F.col(c), F.lit(False))
    types = F.concat(F.when(~shown("include_examples"), strings(EXAMPLE_TYPES)).otherwise(strings([])), F.when(~shown("include_bc"), strings(BC_TYPES)).otherwise(strings([])))
    standards = F.when(~shown("include_framework"), strings(FRAMEWORK_NOS)).otherwise(strings([]))
    named = F.coalesce("standard_no", strings([]))
    type_wins = F.coalesce(F.array_contains(types, F.col("para_type")), F.lit(False))
    standard_wins = F.size(F.array_intersect(standards, named)) > 0
    notes = F.filter(F.array(F.when(type_wins, F.lit("para_type: over the opt-out")), F.when(standard_wins, F.lit("standard_no: over the opt-out"))), lambda n: n.isNotNull())
    return requests.withColumn("top_k", top_k).select(
        "*", wrong.alias("error"), F.filter(types, lambda t: ~t.eqNullSafe(F.col("para_type"))).alias("hide_types"), F.array_except(standards, named).alias("hide_standards"), notes.alias("override_notes")
    )


def _wanted() -> Column:
    """Whether a point passes the filters of the request beside it."""
    one_of = lambda c, values: (F.size(F.coalesce(values, strings([]))) < 1) | F.array_contains(values, F.col(c))
    return one_of("standard_no", F.col("f_standard")) & one_of("source_type", F.col("f_source")) & (F.col("f_type").isNull() | (F.col("f_type") == F.col("para_type")))


def ranked_hits(index: SearchIndex, asked: DataFrame, query_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """qid, key, rank, score, baseline: the fused lists of the search (baseline = false) and of the one without opt-outs.

    Payload meets vectors, and filters meet queries, before the two sides meet: what a filter hides is never scored, and each task keeps PREFETCH a list before anything is shuffled.
    """
    key = index.manifest["key"]
    filters = search.few(asked.select("qid", F.col("standard_no").alias("f_standard"), F.col("source_type").alias("f_source"), F.col("para_type").alias("f_type"), "hide_types", "hide_standards"))
    payload = index.points.select(key, "standard_no", "source_type", "para_type")
    sparse = index.sparse_scores(index.tokens(asked, "qid", "query"), "qid", payload).join(filters, "qid").where(_wanted())
    dealt = vectors.join(payload, key).repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    dense = dealt.join(search.few(query_vectors.select("qid", F.col("vec").alias("_q")).join(filters, "qid")), _wanted()).withColumn("score", F.round(dot(F.col("vec"), F.col("_q")), 9))
    lists = []
    for rows in (sparse, dense):
        out = F.array_contains("hide_types", F.col("para_type")) | F.array_contains("hide_standards", F.col("standard_no"))
        which = F.when(out, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
        both = rows.select("qid", key, "score", F.explode(which).alias("baseline"))
        rank = F.row_number().over(Window.partitionBy("qid", "baseline").orderBy(F.desc("score"), key))
        lists.append(both.withColumn("rank", rank).where(F.col("rank") <= search.PREFETCH))
    fused = lists[0].unionByName(lists[1]).groupBy("qid", "baseline", key).agg(F.round(F.sum(1 / (F.lit(float(search.RRF_K)) + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "baseline").orderBy(F.desc("score"), key)).cast("long"))


def search_points(index: SearchIndex, requests: DataFrame, query_vectors: DataFrame, vectors: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The results (qid, rank, cid, score, payload, text, notes), what was applied (a row for each valid request), and all requests with their errors.

    query_vectors: qid, vec; vectors: the index's key, vec. Parts of a paragraph count once, at the best of their
    ranks, before the limit. A query without known tokens is fused from the dense list alone. With a folder the
    ranked lists, of which results, texts and counts are made, are written there once.
    """
    key, checked = index.manifest["key"], policy(requests)
    asked = checked.where("error is null")
    hits = ranked_hits(index, asked, query_vectors, vectors)
    if folder:
        hits.write.mode("overwrite").parquet(folder)
        hits = requests.sparkSession.read.schema(hits.schema).parquet(folder)
    points = index.points
    own = hits.where("not baseline").join(points.select(key, "composite_id"), key).withColumn("cid", logical_id(F.col("composite_id")))
    own = own.groupBy("qid", "cid").agg(F.min("rank").alias("best"), F.max("score").alias("score"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("best")).cast("long")).join(asked.select("qid", "top_k"), "qid").where("rank <= top_k")
    shown = own.select(F.col("cid").alias("_c")).distinct()
    shown = search.few(shown) if folder else shown
    whole = reassembled_points(points.withColumn("_c", logical_id(F.col("composite_id"))).join(shown, "_c", "left_semi").drop("_c"))
    notes = F.filter(F.array(reassembly_note(F.col("n_parts")), F.when(F.col("para_type") == REFERENCE_TYPE, F.lit(REFERENCE_NOTE))), lambda n: n.isNotNull())
    results = own.join(whole, "cid").select("qid", "rank", "cid", "score", "standard_no", "standard_title", "para_no", "para_type", "section_path", "text", notes.alias("notes"))

    seen = hits.where("baseline").join(asked.select("qid", "top_k", "hide_types", "hide_standards"), "qid").where("rank <= top_k").join(points.select(key, "para_type", "standard_no"), key)
    hidden = F.array_contains("hide_types", F.col("para_type"))
    count = lambda c: F.count(F.when(c, 1))
    counts = seen.groupBy("qid").agg(
        count(hidden & F.col("para_type").isin(EXAMPLE_TYPES)).alias("examples_excluded"),
        count(hidden & F.col("para_type").isin(BC_TYPES)).alias("bc_excluded"),
        count(F.array_contains("hide_standards", F.col("standard_no"))).alias("framework_excluded"),
    )
    oov = index.out_of_vocabulary(index.tokenizer(asked, "qid", "query"), "qid")
    known = index.tokens(asked, "qid", "query").groupBy("qid").agg(F.count("*").alias("n_tokens"))
    applied = asked.join(counts, "qid", "left").join(oov, "qid", "left").join(known, "qid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    no_tokens = F.coalesce(F.size("oov"), F.lit(0)) >= zero("n_tokens")
    more = F.array(F.when(no_tokens, F.lit("dense only: no known token")), *(F.when(zero(c) > 0, F.concat(zero(c).cast("string"), F.lit(f" hidden: {flag}=true shows them"))) for c, flag in (("examples_excluded", "include_examples"), ("bc_excluded", "include_bc"), ("framework_excluded", "include_framework"))))
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    applied = applied.select(
        "qid", F.struct(filled("standard_no").alias("standard_no"), filled("source_type").alias("source_type"), "para_type").alias("filters"), F.coalesce("oov", strings([])).alias("oov_query_tokens"),
        *(zero(c).alias(c) for c in ("examples_excluded", "bc_excluded", "framework_excluded")), F.concat("override_notes", F.filter(more, lambda n: n.isNotNull())).alias("notes"),
    )
    return results, applied, checked.select("qid", "error")


# ---- definitions


def injected_definitions(asked: DataFrame, results: DataFrame, entries: DataFrame) -> DataFrame:
    """asked: qid, query, standard_no; results: of search_points; entries: term, ord, definition, source_id, standard_no -> qid, pos, term, source_cid, standard_no, text.

    Terms of the query first (the longest; none inside another), then those of the results' texts by frequency.
    Of several entries the context's standard picks: the first one filtered for, else the results' commonest.
    A term out of the results whose entry is itself a result is left out; five remain at most.
    """
    entries = entries.withColumn("norm", gloss_norm(F.col("term")))
    norms = entries.where(F.length("norm") >= 2).groupBy(F.col("norm").alias("term")).agg(F.min("ord").alias("ord"))
    own = glossary.longest_matches(asked.select("qid", "query"), "qid", "query", norms).distinct()
    derived = glossary.result_terms(results, "qid", "text", norms, own)
    first = lambda order: F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    own = own.join(norms, "term").withColumn("pos", first([F.desc(F.length("term")), "ord"])).select("qid", "term", "pos", F.lit(True).alias("asked"))
    derived = derived.join(norms, "term").withColumn("pos", first([F.desc("cnt"), F.desc(F.length("term")), "ord"]) + 1000).select("qid", "term", "pos", F.lit(False).alias("asked"))
    commonest = results.groupBy("qid", "standard_no").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    commonest = commonest.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "r"))).where("_k = 1").select("qid", F.col("standard_no").alias("common"))
    context = asked.select("qid", F.get("standard_no", F.lit(0)).alias("filtered")).join(commonest, "qid", "left").select("qid", F.coalesce("filtered", "common").alias("ctx"), F.col("filtered").isNotNull().alias("strong"))
    rows = own.unionByName(derived).withColumnRenamed("term", "norm").join(context, "qid").join(entries, "norm")
    same, dedicated = F.coalesce(F.col("standard_no") == F.col("ctx"), F.lit(False)), F.instr("source_id", DEDICATED) > 0
    best = F.row_number().over(Window.partitionBy("qid", "norm").orderBy(F.desc(F.col("strong") & same), F.desc(dedicated), F.desc(same), "ord"))
    picked = rows.withColumn("_k", best).where("_k = 1")
    shown = results.select("qid", F.col("cid").alias("source_id")).distinct().withColumn("_shown", F.lit(True))
    picked = picked.join(shown, ["qid", "source_id"], "left").where(F.col("asked") | F.col("_shown").isNull())
    picked = picked.withColumn("pos", first(["pos"]).cast("long")).where(F.col("pos") <= MAX_DEFINITIONS)
    return picked.select("qid", "pos", "term", F.col("source_id").alias("source_cid"), "standard_no", F.col("definition").alias("text"))


def search_responses(index: SearchIndex, requests: DataFrame, query_vectors: DataFrame, vectors: DataFrame, entries: DataFrame, folder: str | None = None) -> DataFrame:
    """The whole answer to each request in one row: qid, error, results and definitions in order, applied. One that is not valid has its error alone."""
    results, applied, checked = search_points(index, requests, query_vectors, vectors, folder)
    definitions = injected_definitions(requests.select("qid", "query", "standard_no").join(applied.select("qid"), "qid", "left_semi"), results, entries)
    listed = lambda rows, order, name: rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rows.columns if c not in ("qid", order))))).alias(name))
    whole = checked.join(applied.select("qid", F.struct(*(c for c in applied.columns if c != "qid")).alias("applied")), "qid", "left")
    for rows, order, name in ((results, "rank", "results"), (definitions, "pos", "definitions")):
        found = listed(rows, order, name)
        whole = whole.join(found, "qid", "left").withColumn(name, F.when(F.col("error").isNull(), F.coalesce(name, F.array().cast(found.schema[name].dataType))))
    return whole


def define_terms(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests: rid, terms (array), context_standard -> rid, pos, raw, error, matched, source_cid, standard_no, text, alternates; a term that is not found has no match.

    entries: term, ord, definition, source_id, standard_no. Levels as in glossary.term_levels; the context's standard picks among the entries of the level.
    """
    n = F.size(F.coalesce("terms", strings([])))
    wrong = first_error((~n.between(1, MAX_TERMS), error("INVALID_INPUT", F.concat(n.cast("string"), F.lit(" terms")), "1 to 10")))
    checked = requests.withColumn("error", wrong)
    asked = checked.where("error is null").select("rid", "context_standard", F.posexplode("terms").alias("pos", "raw"))
    hits = glossary.term_levels(asked.select("raw").distinct(), entries).join(entries.select("ord", "standard_no", "definition"), "ord")
    rows = asked.join(hits, "raw", "left")
    same = F.coalesce(F.col("standard_no") == F.col("context_standard"), F.lit(False))
    entry = F.struct((~same).alias("other"), "ord", "term", "source_id", "standard_no", "definition")
    rows = rows.groupBy("rid", "pos", "raw").agg(F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), entry))).alias("_e"))
    rest = F.array_sort(F.transform(F.slice("_e", 2, 1 << 30), lambda e: F.struct(e["ord"].alias("ord"), e["source_id"].alias("source_cid"), e["standard_no"].alias("standard_no"))))
    found = rows.withColumn("_b", F.get("_e", F.lit(0))).select(
        "rid", F.col("pos").cast("long").alias("pos"), "raw", F.lit(None).cast(ERROR).alias("error"), F.col("_b.term").alias("matched"), F.col("_b.source_id").alias("source_cid"), F.col("_b.standard_no").alias("standard_no"),
        F.col("_b.definition").alias("text"), F.when(F.size("_e") > 1, F.transform(rest, lambda e: F.struct(e["source_cid"].alias("source_cid"), e["standard_no"].alias("standard_no")))).alias("alternates"),
    )
    none = checked.where("error is not null").select("rid", *(F.lit(None).cast(found.schema[c].dataType).alias(c) if c != "error" else F.col("error") for c in found.columns[1:]))
    return found.unionByName(none)
