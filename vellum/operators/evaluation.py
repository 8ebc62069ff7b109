"""Evaluation of retrieval and of sources, as one plan over all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import original_number, strip_pattern
from vellum.operators.containment import contained


def recall_at(hits: DataFrame, gold: DataFrame, qid: str, item: str, ks: tuple = (5, 10, 20)) -> DataFrame:
    """qid, n_gold, recall_k..., first_rank: hits has ranks; queries without gold are left out."""
    g = gold.select(qid, item).distinct()
    ranked = hits.groupBy(qid, item).agg(F.min("rank").alias("rank"))
    both = g.join(ranked, [qid, item], "left")
    return both.groupBy(qid).agg(F.count("*").alias("n_gold"), *(F.round(F.count(F.when(F.col("rank") <= k, 1)) / F.count("*"), 9).alias(f"recall_{k}") for k in ks), F.min("rank").alias("first_rank"))


def summary(per_query: DataFrame, k: int = 10) -> DataFrame:
    """Macro and micro recall at k, MRR and the number of queries with gold."""
    r = F.col(f"recall_{k}")
    return per_query.agg(F.bround(F.avg(r), 4).alias("macro_recall"), F.bround(F.sum(r * F.col("n_gold")) / F.sum("n_gold"), 4).alias("micro_recall"), F.bround(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 4).alias("mrr"), F.count("*").alias("n_queries"))


def cited_recall(gold: DataFrame, cited: DataFrame, key: str, code: str) -> DataFrame:
    """key, n_gold, n_hit, n_extra, recall (null without gold), and the codes hit, missed and extra, sorted."""
    both = gold.select(key, code).distinct().withColumn("_g", F.lit(1)).join(cited.select(key, code).distinct().withColumn("_c", F.lit(1)), [key, code], "full")
    found = both.groupBy(key).agg(F.count("_g").alias("n_gold"), F.count(F.when(F.col("_g").isNotNull() & F.col("_c").isNotNull(), 1)).alias("n_hit"), F.count(F.when(F.col("_g").isNull(), 1)).alias("n_extra"),
        *(F.sort_array(F.collect_list(F.when(p, F.col(code)))).alias(n) for n, p in (("hit", F.col("_g").isNotNull() & F.col("_c").isNotNull()), ("missed", F.col("_c").isNull()), ("extra", F.col("_g").isNull()))))
    return found.withColumn("recall", F.bround(F.when(F.col("n_gold") > 0, F.col("n_hit") / F.col("n_gold")), 4))


def segments(pages: DataFrame, scope: str, order: str, text: str, overlap: int, size: int = 1 << 16) -> DataFrame:
    """scope, segment, stream: the texts of a scope in order, joined by a blank, in segments of `size` characters and `overlap` more.

    Whatever is no longer than `overlap` and stands in the joined text stands in one of its segments, and no scope is ever one string.
    """
    by = Window.partitionBy(scope).orderBy(order)
    at = pages.select(scope, order, F.length(text).alias("_n")).withColumn("_from", F.coalesce(F.sum(F.col("_n") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("_last", F.lead(order).over(by).isNull())
    rows = pages.select(scope, order, F.col(text).alias("_t")).join(at, [scope, order]).withColumn("_t", F.concat("_t", F.when(F.col("_last"), "").otherwise(" ")))
    low, high = F.greatest(F.floor((F.col("_from") - overlap) / size), F.lit(0)), F.floor((F.col("_from") + F.col("_n")) / size)
    rows = rows.withColumn("segment", F.explode(F.sequence(low, high)))
    start = F.greatest(F.col("segment") * size - F.col("_from"), F.lit(0))
    end = F.least((F.col("segment") + 1) * size + overlap - F.col("_from"), F.length("_t"))
    rows = rows.where(end > start).select(scope, "segment", order, F.substring(F.col("_t"), (start + 1).cast("int"), (end - start).cast("int")).alias("_t"))
    return rows.groupBy(scope, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "").alias("stream"))


def with_fallbacks(pages: DataFrame, fallbacks: DataFrame, scope: str, order: str) -> DataFrame:
    """The pages of every scope with those of the scopes it falls back on. fallbacks: scope, source, rank (its own rank first, as 0); order becomes (rank, order)."""
    named = fallbacks.select(F.col(scope).alias("_to"), F.col("source").alias(scope), "rank")
    return pages.join(named, scope).withColumn(order, F.struct("rank", F.col(order))).drop(scope, "rank").withColumnRenamed("_to", scope)


def probe_ranks(hits: DataFrame, targets: DataFrame, qid: str, item: str) -> DataFrame:
    """qid, rank: where each probe's target came, null if it did not. Recorded, not a gate."""
    return targets.select(qid, item).distinct().join(hits.groupBy(qid, item).agg(F.min("rank").alias("rank")), [qid, item], "left").groupBy(qid).agg(F.min("rank").alias("rank"))


def containment(lines: DataFrame, pages: DataFrame, key: str, scope: str, order: str, text: str, width: int = 40, guide: Column | None = None) -> DataFrame:
    """key, bucket, rate, n_failed: are a paragraph's lines (key, scope, line_no, line; comparable forms) in their scope's pages (scope, order, text)?

    A line that is there, or is without the number of a footnote at the end of a sentence, weighs max(1, length //
    width); for guides hyphens count for nothing in the second try. Another line weighs its chunks, of which those that
    are there count. Any failing line keeps a paragraph from OK; half or more is PARTIAL. Without lines it is OK.
    """
    guide = F.lit(False) if guide is None else F.coalesce(guide, F.lit(False))
    lines = lines.withColumn("_guide", guide)
    rows = lines.where("line <> ''").withColumn("_tail", F.regexp_replace("line", r"\.\d{1,3}(?=[가-힣(]|$)", "."))
    rows = rows.withColumn("_tail", F.when(F.col("_guide"), F.replace("_tail", F.lit("-"), F.lit(""))).otherwise(F.col("_tail")))
    cut = F.when(F.col("_guide"), F.col("_tail")).otherwise(F.col("line"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(cut) - 1) / width), F.lit(0)).cast("int")), lambda i: F.substring(cut, i * width + 1, F.lit(width)))
    probe = lambda whole, bare, t: F.struct(F.lit(whole).alias("whole"), bare.alias("bare"), t.alias("probe"))
    probes = F.concat(F.array(probe(True, F.lit(False), F.col("line")), probe(True, F.lit(False), F.col("_tail")), probe(True, F.col("_guide"), F.col("_tail"))), F.transform(pieces, lambda c: probe(False, F.col("_guide"), c)))
    rows = rows.select(key, scope, "line_no", F.length("line").alias("_n"), F.explode(probes).alias("p")).select(key, scope, "line_no", "_n", "p.*")
    longest = rows.agg(F.max(F.length("probe"))).first()[0] or 1
    plain, bare = (segments(x, scope, order, text, longest).withColumn("bare", F.lit(b)) for x, b in ((pages, False), (pages.withColumn(text, F.replace(text, F.lit("-"), F.lit(""))), True)))
    streams = plain.unionByName(bare.join(lines.where("_guide").select(scope).distinct(), scope, "left_semi"))
    asked = rows.select(scope, "bare", "probe").distinct()
    there = contained(streams, [scope, "bare", "segment"], "stream", asked, "probe", [scope, "bare"]).select(scope, "bare", "probe").distinct().withColumn("there", F.lit(True))
    rows = rows.join(there, [scope, "bare", "probe"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    per_line = rows.groupBy(key, "line_no", "_n").agg(F.max(F.col("whole") & F.col("there")).alias("ok"), F.count(F.when(~F.col("whole"), 1)).alias("_c"), F.count(F.when(~F.col("whole") & F.col("there"), 1)).alias("_h"))
    n = F.when(F.col("ok"), F.greatest(F.lit(1), F.floor(F.col("_n") / width))).otherwise(F.col("_c"))
    found = per_line.groupBy(key).agg((F.sum(F.when(F.col("ok"), n).otherwise(F.col("_h"))) / F.sum(n)).alias("r"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"))
    found = lines.select(key).distinct().join(found, key, "left").withColumn("n_failed", F.coalesce("n_failed", F.lit(0).cast("long")))
    sound = F.col("n_failed") == 0
    return found.select(key, F.when(sound, "OK").when(F.col("r") >= 0.5, "PARTIAL").otherwise("MISSING").alias("bucket"), F.when(sound, 1.0).otherwise(F.bround("r", 3)).alias("rate"), "n_failed")


def bucket_counts(audited: DataFrame, by: str) -> DataFrame:
    """by, n, ok, partial, missing."""
    return audited.groupBy(by).agg(F.count("*").alias("n"), *(F.count(F.when(F.col("bucket") == b, 1)).alias(b.lower()) for b in ("OK", "PARTIAL", "MISSING")))


def worst(counts: DataFrame, by: str, k: int = 30) -> DataFrame:
    """The k files with most that is partial or missing; those without any are left out."""
    return counts.where("partial + missing > 0").orderBy(F.desc(F.col("partial") + F.col("missing")), by).limit(k)


def mutated(lines: DataFrame, key: str, which: Column, mark: str = "★변조★") -> DataFrame:
    """The lines with the first one of some paragraphs corrupted: an audit is to find each of them, over those it finds anyway."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) == 1
    broken = F.concat(F.substring("line", 1, 10), F.lit(mark), F.expr("substring(line, 31)"))
    return lines.withColumn("_f", first).withColumn("line", F.when(which & F.col("_f"), broken).otherwise(F.col("line"))).drop("_f")


#: The forms of numbers that the audit compares.
COMPARED = r"^(한?\d+(?:\.\d+)*[A-Z]?|[A-Z]{1,3}\d+[A-Z]?(?:\.\d+[A-Z]?)*|BC[A-Z]{1,2}\.?\d+[A-Z]?(?:\.\d+[A-Z]?)*)$"
COMPARED_AUDITING = r"^A?\d+$"


def number_differences(corpus: DataFrame, raw: DataFrame, base: str, number: str, auditing: Column) -> DataFrame:
    """base, number, side: numbers of the corpus (with those their synthetic ids come from) and of the source that the other lacks."""
    both = corpus.select(base, F.explode(F.array(F.col(number), original_number(F.col(number)))).alias(number)).where(F.col(number).rlike(COMPARED))
    both = both.where(~F.coalesce(auditing, F.lit(False)) | F.col(number).rlike(COMPARED_AUDITING))
    return set_difference(both, raw.where(F.col(number).isNotNull()), [base, number]).withColumn("side", F.when(F.col("side") == "a", "corpus").otherwise("raw"))


def reparsed(rows: DataFrame, key: str, head: str, unnumbered: str = "(무번호)") -> DataFrame:
    """Lines -> key, seq, number, n_lines, text: a second parser, in which a section ends the paragraph and lines after it without a head are a paragraph of their own."""
    by = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("_k", F.when(F.col("line").startswith("## "), "section").when(F.col("line").rlike(head), "head").when(F.col("line").rlike(r"(?U)\S"), "text")).where("_k is not null")
    opens = (F.col("_k") == "head") | ((F.col("_k") == "text") & (F.coalesce(F.lag("_k").over(by), F.lit("section")) == "section"))
    rows = rows.withColumn("seq", F.sum(opens.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_k <> 'section'")
    text = F.when(F.col("_k") == "head", F.regexp_replace("line", head, "$2")).otherwise(F.col("line"))
    found = rows.groupBy(key, "seq").agg(F.max(F.when(F.col("_k") == "head", F.regexp_extract("line", head, 1))).alias("number"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("_l"))
    return found.select(key, "seq", F.coalesce("number", F.lit(unnumbered)).alias("number"), "n_lines", F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias("text"))


def zero_recall(per_query: DataFrame, qid: str, k: int = 20) -> DataFrame:
    """The queries that found none of their gold in k."""
    return per_query.where(F.col(f"recall_{k}") == 0).select(qid, "n_gold").orderBy(qid)


def tracks(queries: DataFrame, qid: str, text: str, leak: str) -> DataFrame:
    """Each query twice: track R as it is, track C without what gives the answer away."""
    raw = queries.withColumn("track", F.lit("R"))
    return raw.unionByName(queries.withColumn(text, strip_pattern(F.col(text), leak)).withColumn("track", F.lit("C"))).withColumn("track_id", F.concat_ws(":", "track", F.col(qid).cast("string")))


def set_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Both ways: rows of a not in b (side = 'a') and of b not in a."""
    return a.select(*on).subtract(b.select(*on)).withColumn("side", F.lit("a")).unionByName(b.select(*on).subtract(a.select(*on)).withColumn("side", F.lit("b")))


def mode_first_seen(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by, value, cnt: the commonest value, the first seen of equals."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("cnt"), F.min(order).alias("_seen"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cnt"), "_seen"))).where("_r = 1").select(by, value, "cnt")
