"""Scalar functions as Column expressions; Pandas UDFs only where Spark has no function (Unicode normal forms, code-point repair)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?U)"  # Unicode classes, as the patterns of the domain expect


#: Marks of footnotes in a text and at its end.
FOOTNOTE_MARK, FOOTNOTE_TAIL = r"\[\^\d+\]", rf"{U}한\d+\)\s*$"


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind that Unicode knows."""
    return F.regexp_replace(c, rf"{U}^\s+|\s+$", "")


def gloss_disp(c: Column) -> Column:
    """A term as shown: footnote marks, bold marks and doubled spaces go."""
    bare = F.regexp_replace(strip(F.regexp_replace(c, FOOTNOTE_MARK, "")), FOOTNOTE_TAIL, "")
    return F.trim(F.regexp_replace(F.translate(bare, "*", ""), rf"{U}\s+", " "))


def gloss_norm(c: Column) -> Column:
    return F.regexp_replace(gloss_disp(c), rf"{U}\s+", "")


def para_series(c: Column) -> Column:
    found = F.regexp_extract(c, r"^한?([A-Z]+)", 1)
    return F.when(found != "", found)


def last_segment(c: Column, sep: str = " > ") -> Column:
    return F.element_at(F.split(c, re.escape(sep)), -1)


def logical_id(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def cid_parts(c: Column) -> Column:
    """code, standard_no, para_no of an id of exactly three parts, else null."""
    parts = F.split(c, "::")
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("code"), parts[1].alias("standard_no"), parts[2].alias("para_no")))


def citations(c: Column, codes: tuple = ("KSA", "KIFRS", "GUIDE")) -> Column:
    """Distinct sorted CODE:standard of all ids cited in a text."""
    body = rf"({'|'.join(codes)})::([A-Za-z0-9.\-]+)::[^\s\]\)\}},;'\"]+"
    found = F.regexp_extract_all(c, F.lit(rf"{U}\b{body}"), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^([A-Z]+)::([^:]+)::.*$", "$1:$2"))))


def strip_pattern(c: Column, pattern: str) -> Column:
    """Removes a pattern, joins the gaps; an emptied text stays as it was."""
    left = F.trim(F.regexp_replace(F.regexp_replace(c, pattern, ""), r"\s{2,}", " "))
    return F.coalesce(F.nullif(left, F.lit("")), c)


def chunks(c: Column, width: int = 40) -> Column:
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / width).cast("int")), lambda i: F.substring(c, i * width + 1, F.lit(width)))).otherwise(F.array(c))


def uuid5(namespace: str, c: Column) -> Column:
    """RFC 4122 version 5 from SHA-1, as an expression."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(c, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, tolerance: float = 1e-3) -> Column:
    n = l2_norm(a)
    return F.when(F.abs(n - 1) <= tolerance, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def number_tuple(c: Column) -> Column:
    """All digit groups as numbers; arrays compare in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def occurrences(c: Column, part: Column) -> Column:
    """Number of times part stands in c, without overlap."""
    return F.when(F.length(part) > 0, ((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def ascii_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, 1 - F.length(F.regexp_replace(c, r"[\x00-\x7f]", "")) / F.length(c)).otherwise(F.lit(0.0))


def lower_latin(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z]+$"), F.lower(c)).otherwise(c)


#: The forms of synthetic numbers that hold the original one.
EXAMPLE_NUMBER, APPENDIX_NUMBER, BASIS_NUMBER = r"^IE사례\d+[A-Z]?-(.+)$", r"^(?:IE|BC)부록([A-Z])-(.+)$", r"^BC-(.+)$"


def original_number(c: Column) -> Column:
    """The number in the source that a synthetic id was made from, or null."""
    part = lambda form, k: F.regexp_extract(c, form, k)
    found = F.when(c.rlike(EXAMPLE_NUMBER), part(EXAMPLE_NUMBER, 1)).when(c.rlike(APPENDIX_NUMBER), F.concat(part(APPENDIX_NUMBER, 1), part(APPENDIX_NUMBER, 2)))
    return found.when(c.rlike(BASIS_NUMBER), part(BASIS_NUMBER, 1))


def nfkc(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, "string")(c)


#: Signs that count as the same when texts are compared, and signs that count for nothing.
SAME_FROM, SAME_TO = "‘’“”–—−―∼〜ㆍ•…‥", "''\"\"----~~··.."
IGNORED = r"[:：「」『』〈〉《》녂녃\[\]{}'\"\s]"
#: What a line of markdown holds beside its text: rules of tables, notes, bullets, marks of items.
RULE, INLINE_NOTE, BULLET = r"^[\s\-:|]+$", r"\[각주:[^\]]*\]", r"^[-*•·▪◦>]\s*"
APPENDIX_ITEM, ITEM = r"^부록-\([a-z0-9]{1,3}\)[\s.]*", r"^\((?:[a-zA-Z]{1,4}|\d{1,2}|[ⅰ-ⅻ]{1,4})\)[\s.]*"


def audit_norm(c: Column) -> Column:
    """Comparable form of a text: NFKC, quotes, dashes and dots folded, brackets, colons and all white space gone."""
    folded = F.translate(nfkc(F.translate(c, "․", "·")), SAME_FROM, SAME_TO)
    return F.regexp_replace(folded, U + IGNORED, "")


def markdown_norm(c: Column) -> Column:
    """Comparable form of a line of markdown; rules between table rows become empty."""
    cells = F.translate(F.regexp_replace(strip(c), r"^\|", ""), "|", " ")
    text = F.translate(cells, "*", "")
    for pattern, instead in ((FOOTNOTE_MARK, " "), ("<br>", " "), (INLINE_NOTE, " "), (BULLET, ""), (APPENDIX_ITEM, ""), (ITEM, "")):
        text = F.regexp_replace(text, pattern, instead)
    return F.when(cells.rlike(U + RULE), F.lit("")).otherwise(audit_norm(text))


def restore_shifted(shift: int, low: int, high: int, parts: int = 3):
    """A Pandas UDF that moves code points in [low, high] by shift, in lines of which one in `parts` is there, not counting blanks at the ends and rounding down, and one at least."""

    def fix(line: str) -> str:
        shifted = lambda ch: low <= ord(ch) <= high
        bare = line.strip()
        if not bare or sum(map(shifted, bare)) < max(1, len(bare) // parts):
            return line
        return "".join(chr(ord(ch) + shift) if shifted(ch) else ch for ch in line)

    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else fix(x)), "string")
