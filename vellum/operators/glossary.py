"""Glossary: definitions out of paragraphs, terms in queries and results, lookup by levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import gloss_norm, last_segment, strip
from vellum.operators import automaton

MAX_DEFINITIONS = 5
#: The title of a section of definitions; the forms in which texts define a term.
DEFINITION_SECTION = r"^(용어의\s*)?정의\s*(\([^)]*\))?$"
MARKED_TERM = r"\*([^*\n:：]{1,60}?)\s*(?:[:：]\s*\*|\*\s*[:：])"
ITEM_TERM, DASH, BULLET = r"^\s*\(([a-z]{1,4})\)\s*(.+)$", r"(?:\s*[–—―-]\s+|\s+[–—―-]\s*)", r"^\s*[-•]\s*"
STOPPED_TERM = r"^([^.]{2,50}?(?:\([A-Za-z ,'-]+\))?)\.\s+(.{10,})"
PROSE_TERM = r"사용(?:하는|되는)\s*[“\"]?([^“”\"\s]{2,25}?)[”\"]?이?란\s"
ITEM_MARK = r"^[a-z]{1,3}\.\s*"
#: Kinds of paragraphs that define nothing, and the kind that always does.
NO_SOURCE, DEFINES = ["결론도출근거", "적용사례"], "정의"


def colon_terms(rows: DataFrame, key: str, document: str = "document") -> DataFrame:
    """key, term, definition of paragraphs of the form `term: definition`."""
    d = F.col(document)
    return rows.where(F.instr(d, ":") > 0).select(key, strip(F.substring_index(d, ":", 1)).alias("term"), strip(F.expr(f"substring({document}, instr({document}, ':') + 1)")).alias("definition"))


def in_definition_section(section: Column) -> Column:
    return last_segment(section).rlike(DEFINITION_SECTION)


def marked_terms(rows: DataFrame, key: str, document: str = "document") -> DataFrame:
    """key, pos, term, definition: from each *term:* mark to the next."""
    terms = F.regexp_extract_all(F.col(document), F.lit(MARKED_TERM), F.lit(1))
    cut = F.split(F.col(document), MARKED_TERM)
    bodies = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))
    both = rows.select(key, F.posexplode(F.arrays_zip(terms.alias("term"), bodies.alias("body"))).alias("pos", "x"))
    return both.select(key, "pos", strip(F.translate("x.term", "*", "")).alias("term"), strip(F.translate("x.body", "*", "")).alias("definition"))


def dash_terms(rows: DataFrame, key: str, document: str = "document") -> DataFrame:
    """key, pos, term, definition of lines `(a) term - definition` (dash within 40 characters) or `(a) term. definition`."""
    line = rows.select(key, F.posexplode(F.split(document, "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace(strip(F.col("line")), BULLET, ""))
    item = F.regexp_extract("line", ITEM_TERM, 2)
    line = line.withColumn("marked", item != "").withColumn("body", F.when(item != "", item).otherwise(F.col("line")))
    dashed = F.col("body").rlike(rf"^.{{0,40}}?{DASH}")
    term = F.when(dashed, F.regexp_extract("body", rf"^(.{{0,40}}?){DASH}(.*)$", 1)).when(F.col("marked"), F.regexp_extract("body", STOPPED_TERM, 1)).otherwise(F.lit(""))
    definition = F.when(dashed, F.regexp_extract("body", rf"^.{{0,40}}?{DASH}(.*)$", 1)).when(F.col("marked"), F.regexp_extract("body", STOPPED_TERM, 2)).otherwise(F.lit(""))
    found = line.select(key, "pos", strip(term).alias("term"), strip(definition).alias("definition"))
    found = found.where((F.length("term") > 0) & (F.length("term") <= 40) & (F.length("definition") >= 5))
    return found.withColumn("term", F.regexp_replace("term", ITEM_MARK, ""))


def prose_terms(rows: DataFrame, key: str, found: DataFrame, document: str = "document") -> DataFrame:
    """key, term, definition of paragraphs without other terms that say `... used term means`."""
    term = F.regexp_extract(document, PROSE_TERM, 1)
    return rows.join(found.select(key).distinct(), key, "left_anti").where(term != "").select(key, term.alias("term"), strip(F.col(document)).alias("definition"))


def extracted(records: DataFrame) -> DataFrame:
    """The glossary of a corpus: source_id, pos, term, term_norm, definition, standard_no, source_type, form.

    records: composite_id, standard_no, source_type, para_type, section_path, document. Definition paragraphs give one
    term each; sections of definitions give marked terms in accounting standards, in auditing standards terms by line and,
    where a paragraph has none, by prose. Conclusions and examples define nothing.
    """
    rows = records.where(~F.col("para_type").isin(NO_SOURCE)).withColumnRenamed("composite_id", "source_id")
    dedicated = rows.where(F.col("para_type") == DEFINES)
    inside = rows.where((F.col("para_type") != DEFINES) & in_definition_section(F.col("section_path")))
    auditing = inside.where("source_type = '감사기준'")
    lines = dash_terms(auditing, "source_id")
    forms = {
        "paragraph": colon_terms(dedicated, "source_id").withColumn("pos", F.lit(0)),
        "marked": marked_terms(inside.where("source_type = '회계기준'"), "source_id"),
        "line": lines,
        "prose": prose_terms(auditing, "source_id", lines).withColumn("pos", F.lit(0)),
    }
    out = None
    for name, found in forms.items():
        found = found.select("source_id", "pos", "term", "definition", F.lit(name).alias("form"))
        out = found if out is None else out.unionByName(found)
    return out.join(rows.select("source_id", "standard_no", "source_type"), "source_id").withColumn("term_norm", gloss_norm(F.col("term")))


def inside_others(terms: DataFrame) -> DataFrame:
    """term, longer: each term that stands in another."""
    distinct = terms.select("term").distinct()
    pairs = automaton.occurrences(distinct.withColumnRenamed("term", "longer"), ["longer"], "longer", distinct, "term")
    return pairs.where("term <> longer").select("term", "longer")


def longest_matches(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """key, term: terms of two characters or more in a text that no longer match of the same text holds."""
    terms = terms.where(F.length("term") >= 2)
    hits = automaton.occurrences(texts, [key], F.regexp_replace(text, r"(?U)\s+", ""), terms, "term").select(key, "term")
    covered = hits.select(key, F.col("term").alias("longer")).join(inside_others(terms), "longer").select(key, "term")
    return hits.join(covered, [key, "term"], "left_anti")


def result_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, picked: DataFrame) -> DataFrame:
    """key, term, cnt: terms counted in result texts (key, rank, text), not nested in what the query itself named; most frequent first, up to twice MAX_DEFINITIONS in all."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: x[text])
    bare = texts.groupBy(key).agg(F.array_join(inside, " ").alias("_t"))
    hits = automaton.occurrences(bare, [key], F.regexp_replace("_t", r"(?U)\s+", ""), terms, "term").withColumnRenamed("n", "cnt").join(terms.select("term", "ord"), "term")
    nested = picked.select(key, F.col("term").alias("longer")).join(inside_others(terms), "longer").select(key, "term")
    hits = hits.join(nested.unionByName(picked.select(key, "term")), [key, "term"], "left_anti")
    spent = picked.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cnt"), F.desc(F.length("term")), "ord"))
    return hits.join(spent, F.col(key) == F.col("_k"), "left").withColumn("_r", rank).where("_r <= greatest(1, 10 - coalesce(_n, 0))").select(key, "term", "cnt")


def representative(entries: DataFrame, by: str, context: Column, dedicated: Column, strong: bool = False) -> DataFrame:
    """One entry per term: with a strong context its own first, then dedicated entries, then the context's, then file order."""
    first = [F.desc(F.coalesce(context, F.lit(False)))] if strong else []
    order = [*first, F.desc(dedicated), F.desc(F.coalesce(context, F.lit(False))), F.col("ord")]
    return entries.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def term_levels(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """raw, level, term, ord, source_id: the entries of the first level that matches.

    1 exact term, 2 normalised, 3 a word of a term's first entry (shortest), 4 part of a term (shortest).
    asked: raw; entries: term, ord, source_id.
    """
    e = entries.withColumn("norm", gloss_norm(F.col("term")))
    head = F.row_number().over(Window.partitionBy("norm").orderBy("ord")) == 1
    e = e.withColumn("_head", head).withColumn("_words", F.when(F.col("_head"), F.transform(F.split("term", r"\s+"), gloss_norm)))
    q = asked.select("raw", gloss_norm(F.col("raw")).alias("q"))
    level = F.when(F.col("term") == F.col("raw"), 1).when(F.col("norm") == F.col("q"), 2).when((F.length("q") >= 2) & F.array_contains(F.col("_words"), F.col("q")), 3).when((F.length("q") >= 2) & F.expr("instr(norm, q) > 0"), 4)
    inside = automaton.occurrences(e.select("norm").distinct(), ["norm"], "norm", q, "q").select("norm", "q")
    by_part = q.join(inside, "q").join(e, "norm").select("raw", "q", "ord")
    by_equality = [q.join(e, F.col(a) == F.col(b)).select("raw", "q", "ord") for a, b in (("term", "raw"), ("norm", "q"))]
    hits = by_part.unionByName(by_equality[0]).unionByName(by_equality[1]).distinct().join(e, "ord").withColumn("level", level).where("level is not null")
    best = F.first(F.struct("level", F.when(F.col("level") > 2, F.length("norm")).otherwise(0), F.when(F.col("level") > 2, F.col("norm")))).over(Window.partitionBy("raw").orderBy("level", F.when(F.col("level") > 2, F.length("norm")).otherwise(0), "ord"))
    hits = hits.withColumn("_best", best).where((F.col("level") == F.col("_best.level")) & ((F.col("level") < 3) | (F.col("norm") == F.col("_best.col3"))))
    return hits.select("raw", F.col("level").cast("int").alias("level"), "term", "ord", "source_id")
