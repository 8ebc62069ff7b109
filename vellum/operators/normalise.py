"""Normalising source files into paragraph files: what a line is, which lines open paragraphs, under which numbers.

Lines are rows (file, line_no, line, ...). What looks back or ahead is a window over a file; only the expected cases of
appendices depend on their own earlier decisions, and go through an SQL aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import gloss_disp, gloss_norm, para_series
from vellum.sources.markdown import annotations

#: The form of a head line, of a head without its period, of a series' first number.
HEAD = (
    r"^(부록-사례\d+|부록-?[0-9A-Za-z()]+|보론\d*-\d+|사례[A-Z]|참조\d+|정의-[가-힣A-Za-z0-9()·-]+"
    r"|IE사례\d+-[0-9A-Za-z.]+|IE부록[A-Z]-\d[0-9A-Za-z.]*|IE부록\d+|BC부록\d+|BC-[0-9A-Za-z.]+"
    r"|한?[A-Z]{0,4}\.?\d[0-9A-Za-z.-]*)\.\s"
)
NO_PERIOD = r"^(?:\*\*)?(한?[A-Z]{1,4}\.?\d[0-9A-Za-z.]*)[ \t]+(\S.*)$"
SERIES_START = r"^한?[A-Z]{1,4}\.?1$"
#: Lines of a zone that belong to no paragraph, and of resolutions.
ZONE_BOILERPLATE = [
    r"^\*{0,2}한국회계기준원은 한국채택국제회계기준 제정시",
    r"^\*{0,2}다만,\s*한국회계기준원이",
    r"^\*이\s*(결론도출근거|적용사례|실무적용지침)",
    r"^\*\*(결론도출근거|적용사례|실무적용지침)\*\*$",
    r"^[·•]?\s*실무적용지침\s*$",
    r"^\*\*(기업회계기준서?|국제회계기준|한국채택국제회계기준|K-IFRS|IFRS|IAS|SIC|IFRIC).{0,70}\*\*$",
]
RESOLUTIONS = [r"^회계기준위원회 위원\s*:", r"회계기준위원회\S*\s*위원\s*\d+인.*의결하였다"]
#: Fixed value: a line that opens a case.
CASE_LINE = r"^사례\s*(\d+)(?:[\s\-–—::].*)?$"


def by_line() -> "Window":
    return Window.partitionBy("file").orderBy("line_no")


def boilerplate(line: Column, zone: bool) -> Column:
    """Whether a stripped line belongs to no paragraph: the zone patterns inside zones, the resolutions outside."""
    found = F.lit(False)
    for p in ZONE_BOILERPLATE if zone else RESOLUTIONS:
        found = found | line.rlike(p)
    return found


def emitted(events: DataFrame) -> DataFrame:
    """The emitter. events: file, pos, kind (section, para, cont), number, text -> file, pos, part, line, in the order of pos and part.

    A section is written before the first paragraph or line after it, unless it is the one written last; of several
    in a row the last that is not counts. A continuation that looks like a head is indented.
    """

    order = Window.partitionBy("file").orderBy("pos")
    lines_before = F.coalesce(F.count_if(F.col("kind") != "section").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    events = events.select("file", "pos", "kind", "number", "text", lines_before.alias("_run"))
    rows = events.where("kind <> 'section'").join(_written_sections(events.where("kind = 'section'")), ["file", "_run"], "left")
    head = F.concat(F.col("number"), F.lit(".\t"), F.coalesce("text", F.lit("")))
    cont = F.when(F.col("text").rlike(HEAD), F.concat(F.lit("\t"), "text")).otherwise(F.col("text"))
    body = F.regexp_replace(F.when(F.col("kind") == "para", head).otherwise(cont), r"(?U)\s+$", "")
    lines = F.concat(F.when(F.col("_s").isNotNull(), F.array(F.lit(""), F.concat(F.lit("## "), "_s"))).otherwise(F.array().cast("array<string>")), F.when(F.col("kind") == "para", F.array(F.lit(""), body)).otherwise(F.array(body)))
    return rows.select("file", "pos", F.posexplode(lines).alias("part", "line"))


def _written_sections(sections: DataFrame) -> DataFrame:
    """sections: file, pos, text, _run (those between the same two lines) -> file, _run, _s: the section that each run writes, if any.

    A run writes its last section, or, where that is the one written last, its last other one. So what stands written after a run is one of these two; which one
    depends on the run before through a map of one bit, and such maps are put together by the last constant one and the number of negations since.
    """
    run, order = Window.partitionBy("file", "_run"), Window.partitionBy("file").orderBy("_run")
    last = F.max_by("text", "pos")
    runs = sections.withColumn("_t", last.over(run)).groupBy("file", "_run", "_t").agg(F.max_by("text", F.when(~F.col("text").eqNullSafe(F.col("_t")), F.col("pos"))).alias("_u"), F.max(F.when(~F.col("text").eqNullSafe(F.col("_t")), True)).alias("_two"))
    runs = runs.withColumns({"_two": F.coalesce("_two", F.lit(False)), "_t1": F.lag("_t").over(order), "_u1": F.lag("_u").over(order), "_first": F.row_number().over(order) == 1})
    after = lambda c: F.col("_two") & F.coalesce(F.col(c) == F.col("_t"), F.lit(False))
    runs = runs.withColumns({"_f0": after("_t1"), "_f1": after("_u1")})
    runs = runs.withColumn("_constant", F.col("_first") | (F.col("_f0") == F.col("_f1")))
    runs = runs.withColumn("_group", F.count_if("_constant").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("file", "_group").orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)
    negations = F.count_if(F.col("_f0") & ~F.col("_f1")).over(group)
    runs = runs.withColumn("_other", F.first("_f0").over(group) != (negations % 2 == 1))
    before = F.when(F.coalesce(F.lag("_other").over(order), F.lit(False)), F.col("_u1")).otherwise(F.col("_t1"))
    written = F.when(F.col("_other"), F.col("_u")).when(F.col("_first") | ~before.eqNullSafe(F.col("_t")), F.col("_t"))
    return runs.select("file", "_run", written.alias("_s"))


def rendered(lines: DataFrame, meta: DataFrame) -> DataFrame:
    """file, text: the lines of `emitted` as one text a file, blank lines not doubled, under front matter. meta: file, ord, key, value."""
    joined = lambda rows, order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, c))), lambda x: x[c]), "\n")
    body = lines.groupBy("file").agg(joined(lines, ("pos", "part"), "line").alias("body"))
    value = F.when(F.col("key") == "standard_no", F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value"))
    front = meta.withColumn("entry", F.concat("key", F.lit(": "), value)).groupBy("file").agg(joined(meta, ("ord",), "entry").alias("front"))
    text = F.regexp_replace(F.regexp_replace("body", r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return front.join(body, "file").select("file", F.concat(F.lit("---\n"), "front", F.lit("\n---\n\n"), text, F.lit("\n")).alias("text"))


def corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Numbers of (file, idx) that the source has wrong, out of a table: file, idx, number."""
    fixed = corrections.select("file", "idx", F.col("number").alias("_n"))
    return rows.join(fixed, ["file", "idx"], "left").withColumn("number", F.coalesce("_n", "number")).drop("_n")


def comment_follows(lines: DataFrame, key: str = "para", ahead: int = 3) -> DataFrame:
    """Adds follows: whether the next line that is not blank, `ahead` lines on at most, is a comment with `key`."""
    said = F.when(F.col("line").rlike(r"(?U)\S"), F.coalesce(F.array_contains(F.map_keys(annotations(F.col("line"))), key), F.lit(False)))
    return lines.withColumn("follows", F.coalesce(F.first(said, True).over(by_line().rowsBetween(1, ahead)), F.lit(False)))


def glossary_rows(lines: DataFrame) -> DataFrame:
    """Table rows of a glossary -> file, line_no, number, term, definition, continues: a row with a first cell is a definition; without one it goes on with the one before."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    rows = lines.where(F.ltrim("line").startswith("|")).withColumn("c", cells).where(~F.forall("c", lambda c: c.rlike("^-*$")) & (F.get("c", F.lit(0)) != "용어"))
    first, rest = F.get("c", F.lit(0)), F.coalesce(F.get("c", F.lit(1)), F.lit(""))
    number = F.when(first != "", F.concat(F.lit("정의-"), gloss_norm(first)))
    out = rows.select("file", "line_no", F.last(number, True).over(by_line().rowsBetween(Window.unboundedPreceding, 0)).alias("number"), F.when(first != "", gloss_disp(first)).alias("term"), rest.alias("definition"), (first == "").alias("continues"))
    return out.where("number is not null and (not continues or definition <> '')")


def wrapped(rows: DataFrame, wraps: DataFrame) -> DataFrame:
    """Term cells that a table broke over two rows, put together. rows: of glossary_rows, with standard_no; wraps: standard_no, fragment, previous (few literal rows)."""
    terms = rows.where("not continues")
    prior = F.lag("term").over(by_line())
    marks = F.broadcast(wraps.select("standard_no", F.col("fragment").alias("term"), F.col("previous").alias("_before"), F.lit(True).alias("_wrap")))
    terms = terms.withColumn("_before", prior).join(marks, ["standard_no", "term", "_before"], "left")
    own = terms.select("file", "line_no", F.coalesce("_wrap", F.lit(False)).alias("_wrap"))
    rows = rows.join(own, ["file", "line_no"], "left").withColumn("_wrap", F.coalesce("_wrap", F.lit(False)))
    rows = rows.withColumn("_group", F.sum((~F.col("continues") & ~F.col("_wrap")).cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull() & (c != ""), F.struct("line_no", c.alias("x"))))), lambda s: s["x"])
    found = rows.groupBy("file", "standard_no", "_group").agg(F.min("line_no").alias("line_no"), F.array_join(ordered(F.col("term")), " ").alias("term"), F.array_join(ordered(F.col("definition")), "\n\t").alias("definition"))
    return found.select("file", "standard_no", "line_no", F.concat(F.lit("정의-"), gloss_norm(F.col("term"))).alias("number"), "term", "definition")


def footnote_runs(rows: DataFrame) -> DataFrame:
    """rows: file, line_no, number (of a para comment, or null), native, is_table, is_break (a section line). Adds footnote.

    In a zone numbered natively a whole number right after a table row is a footnote, and so are the whole numbers that follow on it, up to another number or a section.
    """
    w = by_line()
    whole = F.col("number").rlike(r"^\d+[0-9A-Za-z.]*$") & F.col("native")
    rows = rows.withColumn("_before", F.last(F.when(F.col("number").isNull(), F.col("is_table")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_starts", F.coalesce(whole & F.col("_before"), F.lit(False)))
    ends = F.coalesce(F.col("is_break"), F.lit(False)) | (F.col("number").isNotNull() & ~F.coalesce(whole, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("file", "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("footnote", F.coalesce(whole, F.lit(False)) & (F.max(F.col("_starts").cast("int")).over(within) == 1)).drop("_before", "_starts", "_run")


def isqm_rebuilt(events: DataFrame, opening: str) -> DataFrame:
    """Events of a two-column table (file, pos, kind, number, text) -> events for `emitted`, under an opening section."""
    first = events.groupBy("file").agg((F.min("pos") - 1).alias("pos"))
    first = first.select("file", "pos", F.lit("section").alias("kind"), F.lit(None).cast("string").alias("number"), F.lit(opening).alias("text"))
    return first.unionByName(events.select("file", "pos", "kind", "number", "text"))


def promoted(rows: DataFrame) -> DataFrame:
    """Heads without a period. rows: file, line_no, line, number (of a paragraph that is sure, or null), candidate (whether the line may be promoted). Adds promoted.

    One is promoted where it starts a series or goes on with the letters of the paragraph before, sure or promoted itself. One that
    goes on leaves the letters as they are, so only sure paragraphs and starts need be looked back for.
    """
    head = F.when(F.col("candidate") & F.col("line").rlike(NO_PERIOD), F.regexp_extract("line", NO_PERIOD, 1))
    rows = rows.withColumn("_head", head).withColumn("_starts", F.coalesce(F.col("_head").rlike(SERIES_START), F.lit(False))).withColumn("_series", para_series(F.coalesce("_head", "number")))
    sets = F.when(F.col("number").isNotNull() | F.col("_starts"), F.struct("_series"))
    in_force = F.last(sets, True).over(by_line().rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.coalesce(in_force["_series"] == F.col("_series"), F.lit(False))
    return rows.withColumn("promoted", F.when(F.col("_starts") | goes_on, F.col("_head"))).drop("_head", "_starts", "_series")


def appendix_numbers(rows: DataFrame) -> DataFrame:
    """Virtual numbers of appendices. rows: file, line_no, line, opens (an appendix begins), reference, single_case (of that appendix), numbered (a real paragraph). Adds virtual.

    The first line of an appendix that is no paragraph, with no paragraph before it, gets `부록N`, of a list of references `참조N`, of a lone case
    `부록-사례N`. A line `사례 N` opens a case only if N is the next one expected, which a mention in the text is not: only these lines
    and lone cases, few in a file, go through an aggregate in order.
    """
    w = by_line()
    so_far, opens = w.rowsBetween(Window.unboundedPreceding, 0), F.coalesce(F.col("opens"), F.lit(False))
    is_reference, lone = (F.coalesce(F.col(c), F.lit(False)) for c in ("reference", "single_case"))
    found = rows.withColumns({"_appendix": F.count_if(opens).over(so_far), "_reference": F.count_if(opens & is_reference).over(so_far)})
    found = found.withColumn("_kind", F.last(F.when(opens, F.when(is_reference, "reference").when(lone, "case").otherwise("appendix")), True).over(so_far))
    numbered = F.coalesce(F.col("numbered"), F.lit(False))
    eligible = (F.col("_appendix") > 0) & ~opens & ~numbered & F.coalesce(F.col("line").rlike(r"(?U)\S"), F.lit(False))
    within = Window.partitionBy("file", "_appendix").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_eligible", eligible).withColumn("_takes", F.col("_eligible") & (F.coalesce(F.count_if(F.col("_eligible") | (numbered & ~opens)).over(within), F.lit(0)) == 0))
    stripped = F.regexp_replace(F.regexp_replace("line", "^>+", ""), r"(?U)^\s+|\s+$", "")
    named = F.when(F.col("_eligible"), F.regexp_extract(stripped, CASE_LINE, 1))
    found = found.withColumn("_named", F.when(named != "", named.cast("decimal(38,0)"))).withColumn("_lone", F.col("_takes") & (F.col("_kind") == "case"))
    event = F.struct("line_no", "_named", "_lone")
    cases = found.where("_named is not null or _lone").groupBy("file").agg(F.array_sort(F.collect_list(event)).alias("e"))
    line_no = dict(rows.dtypes)["line_no"]
    none = F.struct(F.lit(1).cast("long").alias("next"), F.array().cast(f"array<struct<line_no: {line_no}, case: bigint>>").alias("got"))
    step = lambda s, e: F.when(e["_lone"] | F.coalesce(e["_named"] == s["next"], F.lit(False)), F.struct((s["next"] + 1).alias("next"), F.concat(s["got"], F.array(F.struct(e["line_no"].alias("line_no"), s["next"].alias("case")))).alias("got"))).otherwise(s)
    cases = cases.select("file", F.explode(F.aggregate("e", none, step)["got"]).alias("c")).select("file", "c.line_no", F.col("c.case").alias("_case"))
    found = found.join(cases, ["file", "line_no"], "left")
    of_appendix = F.when(F.col("_kind") == "reference", F.concat(F.lit("참조"), "_reference")).otherwise(F.concat(F.lit("부록"), "_appendix"))
    virtual = F.when(F.col("_case").isNotNull(), F.concat(F.lit("부록-사례"), "_case")).when(F.col("_takes"), of_appendix)
    return found.withColumn("virtual", virtual).select(*rows.columns, "virtual")
