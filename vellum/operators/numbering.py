"""List numbers and synthetic numbers of a file's lines, by windows.

A counter of a list is known from its last anchor (where it was given a start, or a higher level took it back) and the
rows of its own level since then; a scope from the last section that names one and what has raised it since. Both are running counts, so
nothing is folded row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The formats a number may have; any other gives none. Letters go round after z.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Forms of numbers and titles.
PLAIN, LETTERED = r"^\d+[0-9A-Za-z.]*$", r"^([A-Z])(\d+[A-Z]?)$"
NAMED_CASE, NAMED_APPENDIX = r"사례\s*(\d+)", r"^부록\s*([A-Z])\b"
NATIVE = ["BC", "IE", "IG"]

BEFORE, SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def formatted(kind: Column, n: Column) -> Column:
    """n as a list's format writes it, null for other formats."""
    letter = F.substring(F.lit(LETTERS), F.pmod(n - 1, F.lit(len(LETTERS))).cast("int") + 1, F.lit(1))
    return F.when(kind == "decimal", n.cast("string")).when(kind == "lowerLetter", letter).when(kind == "upperLetter", F.upper(letter))


def numbering_expand(rows: DataFrame, by: str, definitions: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """rows: by, pos, list_id, level, format, template, start, and perhaps abstract_id and override (a list's own start) -> with label.

    Counters belong to the abstract list, which several lists may share. All own starts of a list count where it is first used. A
    number takes the deeper levels back to their starts; %k in a template is level k, its start where no row has come to it, empty if the list has
    no such level. A bullet, an empty template and a level of another format give no label.

    definitions: by, abstract_id, level, format, template, start of every level a list has; starts: by, list_id, level, override. Without
    them both are learned from the rows, which is right where every level that matters has a row.
    """
    abstract = F.col("abstract_id") if "abstract_id" in rows.columns else F.col("list_id")
    listed = rows.select(by, "pos", abstract.alias("_a"), F.col("list_id").alias("_l"), F.col("level").cast("int").alias("_level"), "format", "template", "start", *(["override"] if "override" in rows.columns else []))
    listed = listed.where("_a is not null and _l is not null")
    if definitions is None:
        listed = listed.where("format is not null")
    first = lambda c: F.min_by(c, "pos").alias(c)
    if definitions is None:
        levels = listed.groupBy(by, "_a", "_level").agg(first("format"), F.min_by("start", "pos").alias("start"))
    else:
        levels = definitions.select(by, F.col("abstract_id").alias("_a"), F.col("level").cast("int").alias("_level"), "format", "start")
    levels = levels.select(by, "_a", F.col("_level").alias("_k"), F.col("format").alias("_format"), F.coalesce(F.col("start").cast("long"), F.lit(1)).alias("_start"))
    if starts is None:
        own = listed.where("override is not null").groupBy(by, "_l", "_level").agg(first("override")) if "override" in rows.columns else listed.limit(0).withColumn("override", F.lit(None))
    else:
        own = starts.withColumnsRenamed({"list_id": "_l", "level": "_level"})
    own = own.select(by, "_l", F.col("_level").cast("int").alias("_k"), F.col("override").cast("long").alias("_first"))

    begins = F.row_number().over(Window.partitionBy(by, "_l").orderBy("pos")) == 1
    used = listed.withColumn("_begins", begins).select(by, "pos", "_a", "_l", "_level", "_begins")
    known = levels.select(by, "_a", F.col("_k").alias("_level"), F.lit(True).alias("_known"))
    used = used.join(known, [by, "_a", "_level"], "left").withColumn("_at", F.when(F.col("_known"), F.col("_level")))
    # a row for each row and level of its list: what the row does to the level's counter
    each = used.join(levels, [by, "_a"]).join(own, [by, "_l", "_k"], "left")
    given = F.when(F.col("_begins"), F.col("_first"))
    back = F.coalesce(F.col("_at") < F.col("_k"), F.lit(False))
    each = each.withColumn("_anchor", back | given.isNotNull()).withColumn("_from", F.when(~back, given - 1)).withColumn("_counts", F.coalesce(F.col("_at") == F.col("_k"), F.lit(False)))
    order = Window.partitionBy(by, "_a", "_k").orderBy("pos")
    each = each.withColumn("_run", F.count_if("_anchor").over(order.rowsBetween(*SO_FAR)))
    run = Window.partitionBy(by, "_a", "_k", "_run").orderBy("pos").rowsBetween(*SO_FAR)
    each = each.withColumn("_n", F.count_if("_counts").over(run)).withColumn("_base", F.first(F.when(F.col("_anchor"), F.col("_from"))).over(run))
    value = F.when((F.col("_n") == 0) & F.col("_base").isNull(), F.col("_start")).otherwise(F.coalesce("_base", F.col("_start") - 1) + F.col("_n"))
    shown = each.where("_at is not null").groupBy(by, "pos").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_k").alias("k"), F.coalesce(formatted(F.col("_format"), value), F.lit("\0")).alias("v")))).alias("_shown"))

    found = rows.join(shown, [by, "pos"], "left")
    if definitions is not None:
        of_level = definitions.select(by, F.col("abstract_id").alias("_a"), F.col("level").alias("_level"), F.col("format").alias("_f"), F.col("template").alias("_t"))
        found = found.withColumn("_a", abstract).withColumn("_level", F.col("level")).join(of_level, [by, "_a", "_level"], "left")
    else:
        found = found.withColumn("_f", F.col("format")).withColumn("_t", F.col("template"))
    label = F.col("_t")
    for k in range(10):
        label = F.replace(label, F.lit(f"%{k}"), F.coalesce(F.col("_shown")[k - 1], F.lit("")))
    sound = F.col("_shown").isNotNull() & ~F.col("_f").eqNullSafe("bullet") & (F.length("_t") > 0) & (F.instr(label, "\0") == 0)
    return found.withColumn("label", F.when(sound, label)).select(*rows.columns, "label")


def synthetic_number_scope(rows: DataFrame, by: str) -> DataFrame:
    """rows: by, pos, zone, number, and perhaps section (the heading in force) -> with synthetic_id, null where a number makes none.

    Native numbers stay. In zone BC the number follows `BC-`; in the others a letter series gives `IE부록X-n`, and so does a number
    under an appendix section; any other number is in the scope of an example, which rises when a number does not,
    begins anew at a section (with the number that names, if any) and is 1 at least.
    """
    section = F.col("section") if "section" in rows.columns else F.lit(None).cast("string")
    order = Window.partitionBy(by).orderBy("pos")
    so_far, before = order.rowsBetween(*SO_FAR), order.rowsBetween(*BEFORE)
    found = rows.withColumn("_title", F.last(section, True).over(so_far))
    found = found.withColumn("_changes", F.coalesce(section.isNotNull() & ~section.eqNullSafe(F.last(section, True).over(before)), F.lit(False)))
    named = F.regexp_extract("_title", NAMED_CASE, 1)
    found = found.withColumn("_named", F.when(F.col("_changes") & (named != ""), named.cast("long")))

    number, zone = F.col("number"), F.upper(F.coalesce("zone", F.lit("")))
    native = F.substring(number, 1, 2).isin(NATIVE)
    letter, plain = number.rlike(LETTERED), number.rlike(PLAIN)
    appendix = F.regexp_extract(F.coalesce("_title", F.lit("")), NAMED_APPENDIX, 1)
    scoped = number.isNotNull() & plain & ~letter & ~native & ~number.startswith("CU") & (zone != "BC") & (appendix == "")
    digits = F.transform(F.regexp_extract_all(number, F.lit(r"(\d+)")), lambda x: x.cast("decimal(38,0)"))
    found = found.withColumn("_scoped", F.coalesce(scoped, F.lit(False))).withColumn("_digits", F.when(F.col("_scoped"), digits))

    found = found.withColumns({"_section": F.count_if("_changes").over(so_far), "_named_so_far": F.count("_named").over(so_far)})
    in_section = Window.partitionBy(by, "_section").orderBy("pos").rowsBetween(*BEFORE)
    found = found.withColumn("_again", F.coalesce(F.col("_digits") <= F.last("_digits", True).over(in_section), F.lit(False)))
    since = Window.partitionBy(by, "_named_so_far").orderBy("pos")
    found = found.withColumns({
        "_zero": F.coalesce(F.first("_named").over(since.rowsBetween(*SO_FAR)), F.lit(0)), "_raised": F.count_if(F.col("_changes") & F.col("_named").isNull()).over(since.rowsBetween(*SO_FAR)),
        "_restarts": F.count_if("_again").over(since.rowsBetween(*SO_FAR)), "_earlier": F.coalesce(F.max("_scoped").over(since.rowsBetween(*BEFORE)), F.lit(False)),
    })
    lifts = F.col("_scoped") & ~F.col("_earlier") & (F.col("_zero") + F.col("_raised") == 0)  # the first number without a scope makes it 1
    scope = F.col("_zero") + F.col("_raised") + F.col("_restarts") + F.coalesce(F.max(lifts.cast("long")).over(since.rowsBetween(*SO_FAR)), F.lit(0))
    found = found.withColumn("_scope", scope)
    made = F.when(native, number).when(number.startswith("CU") | ~(letter | plain), F.lit(None).cast("string")).when(zone == "BC", F.concat(F.lit("BC-"), number))
    made = made.when(letter, F.concat(F.lit("IE부록"), F.regexp_extract(number, LETTERED, 1), F.lit("-"), F.regexp_extract(number, LETTERED, 2)))
    made = made.when(appendix != "", F.concat(F.lit("IE부록"), appendix, F.lit("-"), number)).otherwise(F.concat(F.lit("IE사례"), F.col("_scope").cast("string"), F.lit("-"), number))
    return found.withColumn("synthetic_id", F.when(number.isNotNull(), made)).select(*rows.columns, "synthetic_id")
