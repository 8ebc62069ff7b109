"""Lines to typed, addressable paragraphs, as windows over the lines of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 0), line."""
    return files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def classified(rows: DataFrame, head: Column, section: Column) -> DataFrame:
    """Adds kind: head, section, text or blank, in this order."""
    return rows.withColumn("kind", F.when(head, "head").when(section, "section").when(F.trim("line") != "", "text").otherwise("blank"))


def paragraphs(rows: DataFrame, key: str, section_of: Column, head: str | None = None) -> DataFrame:
    """Classified lines -> key, seq, section_path, document, char_len, has_table, and para_no where `head` is given.

    `head` is the pattern of a head line; its first group is the number, and what it matches is no part of the
    document. A head opens a paragraph until the next one; what stands before the first is dropped. The section is
    the one in force at the head. A section line inside a paragraph stays, as `section_of` it, only if
    text follows in the same paragraph; blanks stay inside, unless a section is pending, and go at the end.
    """
    by = Window.partitionBy(key).orderBy("line_no")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seq", F.sum((F.col("kind") == "head").cast("long")).over(upto))
    rows = rows.withColumn("section_path", F.last(F.when(F.col("kind") == "section", section_of), True).over(upto))
    rows = rows.where("seq > 0")
    inside = Window.partitionBy(key, "seq").orderBy("line_no")
    whole = Window.partitionBy(key, "seq")
    rows = rows.withColumn("_last", F.max(F.when(F.col("kind").isin("head", "text"), F.col("line_no"))).over(whole))
    rows = rows.withColumn("_before", F.last(F.when(F.col("kind") != "blank", F.col("kind")), True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where((F.col("line_no") <= F.col("_last")) & ~((F.col("kind") == "blank") & (F.col("_before") == "section")))
    body = F.when(F.col("kind") == "section", F.element_at(F.split(section_of, " > "), -1)).when(F.col("kind") == "head", F.col("line") if head is None else F.regexp_replace("line", head, "")).otherwise(F.col("line"))
    number = [] if head is None else [F.max(F.when(F.col("kind") == "head", F.regexp_extract("line", head, 1))).alias("para_no")]
    found = rows.groupBy(key, "seq").agg(
        F.max(F.when(F.col("kind") == "head", F.col("section_path"))).alias("section_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("b")))), lambda x: x["b"]), "\n").alias("document"),
        F.max(F.col("line").rlike(r"^\s*\|")).alias("has_table"),
        *number,
    )
    return found.withColumn("char_len", F.length("document").cast("long"))


def para_type(source_type: Column, para_no: Column) -> Column:
    """The kind of a paragraph by its number: the first case that holds."""
    accounting, auditing = source_type == "회계기준", source_type == "감사기준"
    return (
        F.when(accounting & para_no.startswith("BC"), "결론도출근거")
        .when(accounting & para_no.rlike("^I[EG]"), "적용사례")
        .when(para_no.startswith("정의-"), "정의")
        .when(para_no.rlike(r"^참조\d+$"), "참조")
        .when(para_no.rlike(r"^(부록\d+|부록-사례\d+|사례[A-Z])$"), "부록")
        .when(auditing, F.when(para_no.rlike(r"^\d+(\.\d+)*$"), "요구사항").otherwise("적용지침"))
        .when(accounting, F.when(para_no.rlike(r"^한?\d[0-9.]*$"), "본문").otherwise("적용지침"))
        .otherwise("본문")
    )


def split_at(rows: DataFrame, key: str, marker: Column, first_only: bool = True) -> DataFrame:
    """Cuts each key's lines (line_no, line) before the first line that holds `marker`, a number per marker (null: none).

    key, part_no, part_total, document: parts in order, right-stripped, empty parts dropped.
    """
    cut = Window.partitionBy(key, "_m")
    rows = rows.withColumn("_m", marker)
    rows = rows.withColumn("_cut", F.col("_m").isNotNull() & (F.col("line_no") > 0) & ((F.col("line_no") == F.min("line_no").over(cut)) if first_only else F.lit(True)))
    rows = rows.withColumn("_part", F.sum(F.col("_cut").cast("int")).over(Window.partitionBy(key).orderBy("line_no")))
    parts = rows.groupBy(key, "_part").agg(F.rtrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")).alias("document")).where("document <> ''")
    of = Window.partitionBy(key)
    return parts.select(key, F.row_number().over(of.orderBy("_part")).cast("long").alias("part_no"), F.count("*").over(of).alias("part_total"), "document")


def composite_id(code: Column, standard_no: Column, para_no: Column) -> Column:
    return F.concat_ws("::", code, standard_no, para_no)


def split_targets(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cuts paragraphs at markers. records: composite_id, document, ...; targets: composite_id, ord, marker (few rows, which name the paragraphs).

    Gives all records, those named as parts `#1`, `#2`, ... with part_no and part_total (null for the others),
    and the failures (composite_id, reason): paragraphs or markers not found, a cut at the first line, cuts out of order, empty parts.
    """
    named = records.join(targets.select("composite_id").distinct(), "composite_id", "left_semi")
    at = named.select("composite_id", F.posexplode(F.split("document", "\n", -1)).alias("line_no", "line")).withColumn("bare", F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", "")))
    hit = targets.join(at, "composite_id").where(F.col("bare").startswith(F.col("marker"))).groupBy("composite_id", "ord").agg(F.min("line_no").alias("cut"))
    cuts = targets.join(hit, ["composite_id", "ord"], "left").withColumn("before", F.lag("cut").over(Window.partitionBy("composite_id").orderBy("ord")))
    reason = F.when(F.col("cut").isNull(), "marker not found").when(F.col("cut") == 0, "cut at the first line").when(F.col("cut") <= F.col("before"), "cuts out of order")
    wrong = cuts.select("composite_id", reason.alias("reason")).where("reason is not null")
    starts = cuts.where("cut > 0").groupBy("composite_id").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    parts = at.join(starts, "composite_id").withColumn("part_no", F.size(F.filter("cuts", lambda c: c <= F.col("line_no"))).cast("long") + 1)
    parts = parts.groupBy("composite_id", "part_no").agg(F.rtrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")).alias("part"))
    empty = parts.where(~F.col("part").rlike(r"(?U)\S")).select("composite_id", F.lit("empty part").alias("reason"))
    unknown = targets.select("composite_id").distinct().join(records, "composite_id", "left_anti").select("composite_id", F.lit("paragraph not found").alias("reason"))
    parts = parts.withColumn("part_total", F.count("*").over(Window.partitionBy("composite_id")))
    rest = [c for c in records.columns if c not in ("composite_id", "document", "char_len", "has_table", "part_no", "part_total")]
    cut = named.select("composite_id", *rest).join(parts, "composite_id").select(
        F.concat("composite_id", F.lit("#"), "part_no").alias("composite_id"), *rest, F.col("part").alias("document"), F.length("part").cast("long").alias("char_len"),
        F.col("part").rlike(r"(?m)^\s*\|").alias("has_table"), "part_no", "part_total",
    )
    whole = records.join(targets.select("composite_id").distinct(), "composite_id", "left_anti").select(
        "composite_id", *rest, "document", F.length("document").cast("long").alias("char_len"), F.col("document").rlike(r"(?m)^\s*\|").alias("has_table"), F.lit(None).cast("long").alias("part_no"), F.lit(None).cast("long").alias("part_total"),
    )
    failures = wrong.unionByName(empty).unionByName(unknown.where(F.col("composite_id").isNotNull()))
    return whole.unionByName(cut), failures.distinct()


def synthetic_text(head: Column, section: Column, document: Column, part_no: Column | None = None, part_total: Column | None = None, suffix: Column | None = None) -> Column:
    """What is indexed for a paragraph: head | section (n/N) suffix | document."""
    part = F.lit("") if part_no is None else F.coalesce(F.concat(F.lit(" ("), part_no.cast("string"), F.lit("/"), part_total.cast("string"), F.lit(")")), F.lit(""))
    return F.concat(head, F.lit(" | "), F.coalesce(section, F.lit("")), part, F.lit("") if suffix is None else F.coalesce(suffix, F.lit("")), F.lit(" | "), document)


def reassembled(parts: DataFrame, key: str) -> DataFrame:
    """key, document, n_parts: fragments joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "document")))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["document"]), "\n").alias("document"), F.count("*").alias("n_parts"))
