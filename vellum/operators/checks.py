"""Integrity checks as violation queries: an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import l2_norm, l2_normalise


def continuity(rows: DataFrame, by: str, seq: str, first: int = 1) -> DataFrame:
    """by, n, lo, hi of groups whose numbers are not first, first + 1, ... each once."""
    x = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(seq).cast("long").alias("lo"), F.max(seq).cast("long").alias("hi"), F.count_distinct(seq).alias("_d"))
    return x.where((F.col("lo") != first) | (F.col("hi") != F.col("n") + (first - 1)) | (F.col("_d") != F.col("n"))).drop("_d")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def gaps(rows: DataFrame, by: str, number: str, allowed: DataFrame | None = None) -> DataFrame:
    """by, after, before: where the next distinct number is not the next integer; gaps in `allowed` (by, after) pass."""
    x = rows.select(by, F.col(number).cast("long").alias("after")).distinct()
    x = x.withColumn("before", F.lead("after").over(Window.partitionBy(by).orderBy("after"))).where("before > after + 1")
    return x if allowed is None else x.join(allowed, [by, "after"], "left_anti")


def first_mismatch(a: DataFrame, b: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    """by, pos: the first place where two sequences differ or one ends."""
    both = a.select(by, pos, F.col(value).alias("_a")).join(b.select(by, pos, F.col(value).alias("_b")), [by, pos], "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).groupBy(by).agg(F.min(pos).alias("pos"))


# ---- validation of written files: lines are file, line_no, line; paragraphs file, seq, para_no

#: Paragraphs of these beginnings may hold sections, and the size above which a paragraph is suspect.
HOLDERS, MAX_SIZE = ("부록", "보론", "사례", "참조", "정의"), 6000


def heads(lines: DataFrame, head: str) -> DataFrame:
    """file, seq, para_no: the head lines of a file, numbered from 1."""
    found = lines.where(F.col("line").rlike(head)).select("file", "line_no", F.regexp_extract("line", head, 1).alias("para_no"))
    return found.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).cast("long"))


def residual_comments(lines: DataFrame) -> DataFrame:
    return lines.where(F.contains("line", F.lit("<!--"))).groupBy("file").agg(F.count("*").alias("n"))


def unperioded_heads(lines: DataFrame, head: str, suspect: str) -> DataFrame:
    """Lines that look like heads and are none: not indented, of the suspect form."""
    return lines.where(~F.col("line").startswith("\t") & ~F.col("line").rlike(head) & F.col("line").rlike(suspect)).select("file", "line_no", F.substring("line", 1, 40).alias("line"))


def paragraph_sizes(lines: DataFrame, head: str) -> DataFrame:
    """file, seq, para_no, size: the characters of a paragraph's lines, line feeds not counted."""
    seq = F.sum(F.col("line").rlike(head).cast("long")).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("seq", seq).where("seq > 0")
    return rows.groupBy("file", "seq").agg(F.max(F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 1))).alias("para_no"), F.sum(F.length("line")).cast("long").alias("size"))


def section_crossings(lines: DataFrame, head: str, mark: str = "보론") -> DataFrame:
    """file, para_no: paragraphs with text after a section line that holds `mark`, but for those that may hold sections."""
    by = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head, is_section = F.col("line").rlike(head), F.col("line").startswith("## ")
    rows = lines.withColumn("seq", F.sum(is_head.cast("long")).over(by)).where("seq > 0").withColumn("para_no", F.last(F.when(is_head, F.regexp_extract("line", head, 1)), True).over(by))
    rows = rows.withColumn("_marked", F.max((is_section & F.contains("line", F.lit(mark))).cast("int")).over(Window.partitionBy("file", "seq").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    held = F.lit(False)
    for h in HOLDERS:
        held = held | F.col("para_no").startswith(h)
    return rows.where((F.col("_marked") == 1) & ~is_section & F.col("line").rlike(r"(?U)\S") & ~held).select("file", "para_no").distinct()


def expected_counts(found: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """by, want, have: groups whose number of rows is not the expected one; an unexpected group wants 0, an absent one has 0."""
    have = found.groupBy(by).agg(F.count("*").alias("have"))
    both = expected.select(by, F.col("n").cast("long").alias("want")).join(have, by, "full").select(by, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("want", "have")))
    return both.where("want <> have")


def expected_sequences(found: DataFrame, expected: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, pos: where the sequence of values first differs from the expected one (by, pos from 1, value)."""
    have = found.select(by, F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("pos"), value)
    return first_mismatch(have, expected.join(found.select(by).distinct(), by, "left_semi").select(by, F.col("pos").cast("int").alias("pos"), value), by, "pos", value)


def validation(lines: DataFrame, head: str, suspect: str, standard: DataFrame, allowed_gaps: DataFrame | None = None, allowed_sizes: DataFrame | None = None, expected: DataFrame | None = None, galleys: DataFrame | None = None) -> DataFrame:
    """file, check, detail: every violation of the written files; none is a pass.

    standard: file, standard_no; allowed_gaps: file, after; allowed_sizes: file, para_no; expected: file, pos, para_no; galleys: file, n.
    """
    paras = heads(lines, head)
    text = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c))
    row = lambda rows, check, *c: rows.select("file", F.lit(check).alias("check"), text(*c).alias("detail"))
    pseudo = r"^(부록\d+|부록-사례\d+|참조\d+)$"
    big = paragraph_sizes(lines, head).where(F.col("size") > MAX_SIZE)
    if allowed_sizes is not None:
        big = big.join(allowed_sizes, ["file", "para_no"], "left_anti")
    whole = paras.where(F.col("para_no").rlike(r"^\d+$"))
    by_standard = paras.join(standard, "file").groupBy("standard_no", "para_no").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1")
    found = [
        row(duplicates(paras, "file", "para_no"), "repeated number", "para_no", "n"),
        row(residual_comments(lines), "comment left", "n"),
        row(unperioded_heads(lines, head, suspect), "head without a period", "line_no", "line"),
        row(big, "paragraph too long", "para_no", "size"),
        row(gaps(whole, "file", "para_no", allowed_gaps), "numbers left out", "after", "before"),
        row(section_crossings(lines, head), "paragraph across a section", "para_no"),
        row(by_standard, "number in several files", "standard_no", "para_no", "n"),
    ]
    if expected is not None:
        found.append(row(expected_sequences(paras, expected, "file", "seq", "para_no"), "sequence differs", "pos"))
        kinds = (("cut pieces differ", F.col("para_no").rlike(pseudo)), ("definitions differ", F.col("para_no").startswith("정의-")), ("references differ", F.col("para_no").rlike(r"^참조\d+$")), ("cases differ", F.col("para_no").rlike("^사례[A-Z]$")))
        for check, p in kinds:
            found.append(row(expected_counts(paras.where(p), expected.where(p).groupBy("file").agg(F.count("*").alias("n")), "file"), check, "want", "have"))
    if galleys is not None:
        of = paras.join(galleys, "file", "left_semi")
        found.append(row(expected_counts(of, galleys, "file"), "galley size differs", "want", "have"))
        found.append(row(galleys.join(lines.select("file").distinct(), "file", "left_anti"), "galley missing", "n"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


# ---- the load and what the running service is held against


def key_agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys that stand on one side alone; to be empty before two sides are joined by key."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def joined_by_key(records: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Records with their vectors, by key and not by place; refuses if the keys are not the same, or stand twice."""
    if not key_agreement(records, vectors, key).isEmpty() or not duplicates(vectors, key).isEmpty():
        raise ValueError("records and vectors do not have the same keys")
    return records.join(vectors, key)


def vector_problems(vectors: DataFrame, key: str, vector: str, dim: int, tolerance: float = 1e-3) -> DataFrame:
    """key, problem: vectors that are missing, of another length, not finite, or not of length 1."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    problem = F.when(v.isNull(), "missing").when(F.size(v) != dim, "dimension").when(bad, "not finite").when(F.abs(l2_norm(v) - 1) > tolerance, "norm")
    return vectors.select(key, problem.alias("problem")).where("problem is not null")


def norm_summary(vectors: DataFrame, vector: str) -> DataFrame:
    """n, n_nan, lo, hi: one row on the norms of all vectors; NaNs are counted and left out."""
    n = l2_norm(F.col(vector))
    return vectors.select(n.alias("n")).agg(F.count("*").alias("n"), F.count(F.when(F.isnan("n") | F.col("n").isNull(), 1)).alias("n_nan"), F.min(F.when(~F.isnan("n"), F.col("n"))).alias("lo"), F.max(F.when(~F.isnan("n"), F.col("n"))).alias("hi"))


def over_token_limit(tokens: DataFrame, key: str, limit: int = 8192) -> DataFrame:
    """key, n_tokens: texts beyond the encoder's limit. Any such text stops a build; none is cut."""
    return tokens.groupBy(key).agg(F.count("*").alias("n_tokens")).where(F.col("n_tokens") > limit)


def refuse_over_limit(tokens: DataFrame, key: str, limit: int = 8192) -> None:
    """Stops a build that holds a text beyond the limit, with some of their keys."""
    if over := [(r[0], r["n_tokens"]) for r in over_token_limit(tokens, key, limit).orderBy(key).limit(10).collect()]:
        raise ValueError(f"beyond {limit} tokens: {over}")


def external_vectors(records: DataFrame, vectors: DataFrame, key: str, vector: str, dim: int) -> tuple[DataFrame, list[str]]:
    """Records with vectors computed elsewhere, by key, and warnings. Other keys, lengths or values that are not finite are refused; vectors that are not of length 1 are made so."""
    problems = {r["problem"]: r["count"] for r in vector_problems(vectors, key, vector, dim).groupBy("problem").count().collect()}  # a row for each kind
    if fatal := {k: n for k, n in problems.items() if k != "norm"}:
        raise ValueError(f"vectors refused: {fatal}")
    joined = joined_by_key(records, vectors, key)
    return joined.withColumn(vector, l2_normalise(F.col(vector))), [f"{problems['norm']} vectors were not of length 1"] if problems else []


def roundtrip(records: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """key: records whose stored copy is missing or differs."""
    kept = stored.select(key, F.col(text).alias("_s"), F.lit(True).alias("_there"))
    return records.select(key, text).join(kept, key, "left").where(F.col("_there").isNull() | ~F.col(text).eqNullSafe(F.col("_s"))).select(key)


def drift(rows: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """by, want, have: fixed totals that no longer hold."""
    want = rows.sparkSession.createDataFrame([(k, n) for k, n in expected.items()], f"{by} string, n long")
    return expected_counts(rows.select(F.col(by).cast("string").alias(by)), want, by)


def load_gate(records: DataFrame, vectors: DataFrame, expected: int, dim: int) -> DataFrame:
    """check, n_violations: the checks of a load; all are to be 0. records: composite_id, source_file, seq, part_no, part_total; vectors: composite_id, dense.

    One pass: every row says under which key each check looks at it, and one aggregate by (check, key) settles them all.
    """
    look = lambda check, key, n=1, have=None, other=None: F.struct(F.lit(check).alias("check"), key.cast("string").alias("key"), *(F.lit(x).cast("long").alias(c) if not isinstance(x, Column) else x.cast("long").alias(c) for c, x in (("n", n), ("have", have), ("other", other))))
    parted = F.col("part_no").isNotNull()
    mine = [look("points", F.lit("all")), look("sequence", F.col("source_file"), 1, F.col("seq")), look("unique ids", F.col("composite_id")), look("keys", F.col("composite_id"), 1, 1), F.when(parted, look("parts", F.substring_index("composite_id", "#", 1), 1, F.col("part_no"), F.col("part_total")))]
    norm = l2_norm(F.col("dense"))
    bad = F.coalesce((F.size("dense") != dim) | F.isnan(norm) | (F.abs(norm - 1) > 1e-3), F.lit(True))
    theirs = [look("vectors", F.col("composite_id"), bad.cast("long")), look("keys", F.col("composite_id"), 0, 2)]
    rows = records.select(F.explode(F.array_compact(F.array(*mine))).alias("s")).unionByName(vectors.select(F.explode(F.array(*theirs)).alias("s"))).select("s.*")
    checked = rows.groupBy("check", "key").agg(F.sum("n").alias("n"), F.min("have").alias("lo"), F.max("have").alias("hi"), F.count_distinct("have").alias("kinds"), F.count("have").alias("there"), F.min("other").alias("least"), F.max("other").alias("most"))
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("kinds"))
    check = F.col("check")
    wrong = (
        F.when(check == "points", F.abs(F.col("n") - expected)).when(check == "sequence", (~F.coalesce(whole, F.lit(False))).cast("long")).when(check == "unique ids", (F.col("n") > 1).cast("long"))
        .when(check == "vectors", F.col("n")).when(check == "keys", (F.col("kinds") < 2).cast("long"))
        .otherwise((~F.coalesce(whole & (F.col("least") == F.col("most")) & (F.col("most") == F.col("there")) & (F.col("kinds") == F.col("there")), F.lit(False))).cast("long"))
    )
    names = records.sparkSession.createDataFrame([(c,) for c in ("points", "sequence", "unique ids", "vectors", "keys", "parts")], "check string")
    total = checked.groupBy("check").agg(F.sum(wrong).alias("n_violations"))
    none = F.when(F.col("check") == "points", F.lit(expected)).otherwise(F.lit(0)).cast("long")
    return names.join(total, "check", "left").withColumn("n_violations", F.coalesce("n_violations", none))


class ContractMismatch(Exception):
    """The running service and what it would serve were not made for each other: it refuses to start."""

    def __init__(self, item: str, expected, actual, hint: str):
        super().__init__(f"{item}: expected {expected!r}, found {actual!r}. {hint}")
        self.item, self.expected, self.actual, self.hint = item, expected, actual, hint


HINTS = {"sparse": "build the index again, so that vocabulary and weights are of one edition", "embedding": "load the model the index was built with, normalised", "collection": "run the build again", "glossary": "run the build again"}


def contract(expected: dict, actual: dict) -> list[dict]:
    """Items that differ between a stored manifest and the running configuration, with a hint; of versions a differing patch only warns."""
    found = []
    for item, want in expected.items():
        have = actual.get(item)
        if want != have:
            minor = lambda v: ".".join(str(v).split(".")[:2])
            found.append({"item": item, "expected": want, "actual": have, "refuse": not (item.endswith("version") and minor(want) == minor(have)), "hint": HINTS.get(item.split(".")[0], "run the build again")})
    return found


def enforce(expected: dict, actual: dict) -> list[dict]:
    """The warnings; refuses at the first item that may not differ."""
    found = contract(expected, actual)
    for x in found:
        if x["refuse"]:
            raise ContractMismatch(x["item"], x["expected"], x["actual"], x["hint"])
    return found


def probe_encoder(encode, dim: int, text: str = "probe", tolerance: float = 1e-3) -> None:
    """Refuses an encoder (text -> numbers) of another dimension or one that does not normalise."""
    vector = [float(x) for x in encode(text)]
    norm = sum(x * x for x in vector) ** 0.5
    if len(vector) != dim:
        raise ContractMismatch("embedding.dim", dim, len(vector), HINTS["embedding"])
    if not abs(norm - 1) <= tolerance:
        raise ContractMismatch("embedding.probe_norm", 1.0, norm, HINTS["embedding"])
