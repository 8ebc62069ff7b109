"""Queries of the normalising operators. Conversations stand for source files, their turns for lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import normalise
from vellum.plans.base import load, query

EVENTS = "select conv_id as file, turn as pos, case when turn % 3 = 0 then 'section' when turn % 3 = 1 then 'para' else 'cont' end as kind, case when turn % 3 = 1 then concat('A', turn) end as number, case when turn % 3 = 0 then concat('S', turn % 2) when turn % 7 = 2 then concat('12. ', role) else role end as text from conversations"
LINES = "select conv_id as file, turn as line_no, case when turn % 5 = 1 then '<!-- para: 3 | open -->' when turn % 5 = 2 then '  ' when turn % 5 = 4 then '<!-- kind: x -->' else role end as line from conversations"


def turns(spark, sf_dir, sql: str):
    load(spark, sf_dir, "conversations").createOrReplaceTempView("vellum_conversations")
    return spark.sql(sql.replace("from conversations", "from vellum_conversations"))


@query(f"""with e as ({EVENTS}), s as (select *, last_value(case when kind = 'section' then text end ignore nulls) over (partition by file order by pos rows unbounded preceding) as sec from e),
t as (select *, sec is not null and sec is distinct from lag(sec) over (partition by file order by pos) as new_ from s where kind <> 'section'),
l as (select file, pos, case when new_ then ['', '## ' || sec] else [] end || case when kind = 'para' then ['', rtrim(number || '.' || chr(9) || text)] else [case when regexp_matches(text, '^12\\. ') then chr(9) || text else text end] end as w from t)
select file, pos, generate_subscripts(w, 1) - 1 as part, unnest(w) as line from l""")
def emitter_lines(spark, sf_dir):
    return normalise.emitted(turns(spark, sf_dir, EVENTS)).withColumn("part", F.col("part").cast("long"))


@query("select doc_id, case when doc_id % 10 = 3 and lang = 'en' then 'N' || doc_id else source end as number from documents")
def number_corrections(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    fixes = d.where("doc_id % 10 = 3").select(F.lit("en").alias("file"), F.col("doc_id").alias("idx"), F.concat(F.lit("N"), "doc_id").alias("number"))
    return normalise.corrected(d.select(F.col("lang").alias("file"), F.col("doc_id").alias("idx"), F.col("source").alias("number")), fixes).select(F.col("idx").alias("doc_id"), "number")


@query(f"""with l as ({LINES}), n as (select *, row_number() over (partition by file order by line_no) as k from l)
select a.file, a.line_no, coalesce((select first(b.line order by b.k) from n b where b.file = a.file and b.k between a.k + 1 and a.k + 3 and trim(b.line) <> '') like '<!-- para%', false) as follows from n a""")
def comment_lookahead(spark, sf_dir):
    return normalise.comment_follows(turns(spark, sf_dir, LINES)).select("file", "line_no", "follows")


CELLS = "select item_id // 10 as file, item_id as line_no, case item_id % 6 when 0 then '| 용어 | x |' when 1 then '|---|---|' when 2 then concat('|  | ', text, ' |') when 3 then 'text' else concat('| *t', item_id, '* b[^2] | ', text, ' |') end as line from benchmark"


@query(f"""with l as ({CELLS.replace('//', '//')}), b as (select line_no, text from l join benchmark on item_id = line_no), c as (select l.file, l.line_no, l.line_no % 6 as k, trim(split_part(text, '|', 1)) as text from l join b using (line_no)),
n as (select *, last_value(case when k > 3 then '정의-t' || line_no || 'b' end ignore nulls) over (partition by file order by line_no rows unbounded preceding) as number from c where k in (2, 4, 5))
select file, line_no, number, case when k > 3 then 't' || line_no || ' b' end as term, text as definition, k = 2 as continues from n where number is not null and (k > 3 or text <> '')""")
def glossary_table_rows(spark, sf_dir):
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("vellum_benchmark")
    return normalise.glossary_rows(spark.sql(CELLS.replace("item_id // 10", "item_id div 10").replace("from benchmark", "from vellum_benchmark")))


RUNS = "select conv_id as file, turn as line_no, case when (conv_id + turn) % 4 = 0 then null when turn % 7 = 5 then 'BC4' else concat('', turn) end as number, conv_id % 3 > 0 as native, (conv_id + turn) % 8 = 0 as is_table, turn % 11 = 10 as is_break from conversations"


@query(f"""with r as ({RUNS}), p as (select *, native and regexp_matches(coalesce(number, ''), '^[0-9]') as whole, last_value(case when number is null then is_table end ignore nulls) over (partition by file order by line_no rows between unbounded preceding and 1 preceding) as before_ from r),
s as (select *, coalesce(whole and before_, false) as starts, sum(case when is_break or (number is not null and not whole) then 1 else 0 end) over (partition by file order by line_no rows unbounded preceding) as run from p)
select file, line_no, whole and max(case when starts then 1 else 0 end) over (partition by file, run order by line_no rows unbounded preceding) = 1 as footnote from s""")
def footnote_run_flags(spark, sf_dir):
    return normalise.footnote_runs(turns(spark, sf_dir, RUNS)).select("file", "line_no", "footnote")


BOILER = "select conv_id, turn, case turn % 6 when 0 then '**결론도출근거**' when 1 then concat('회계기준위원회 위원 : ', role) when 2 then concat('**IFRS ', turn, '**') when 3 then '이 회계기준위원회의 위원 7인 전원이 의결하였다' when 4 then concat('*이 적용사례 ', role) else role end as line from conversations"


@query(f"with b as ({BOILER}) select conv_id, turn, turn % 6 in (0, 2, 4) as in_zone, turn % 6 in (1, 3) as outside from b")
def boilerplate_lines(spark, sf_dir):
    b = turns(spark, sf_dir, BOILER)
    return b.select("conv_id", "turn", normalise.boilerplate(F.col("line"), True).alias("in_zone"), normalise.boilerplate(F.col("line"), False).alias("outside"))


@query("select doc_id, case when doc_id % 2 = 0 then 'two words' else source end as title, sha256('---' || chr(10) || text) as digest from documents where text is not null and not contains(text, '---')")
def lenient_front_matter_scan(spark, sf_dir):
    """A repeated key, of which the last holds, quotes, and a rule inside the body."""
    from vellum.sources.markdown import lenient_front_matter

    d = load(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("---")))
    head = F.concat(F.lit("---\nno colon\ntitle: first\ntitle: "), F.when(F.col("doc_id") % 2 == 0, F.lit('"two words"')).otherwise(F.col("source")), F.lit("\n---\n---\n"))
    return d.select("doc_id", lenient_front_matter(F.concat(head, "text")).alias("f")).select("doc_id", F.col("f.meta")["title"].alias("title"), F.sha2("f.body", 256).alias("digest"))


COMBINED = "select conv_id as path, turn as pos, case when turn % 5 = 2 then '10' else '3' end as style, case when turn % 10 = 7 then '머리말 5' else concat('감사기준서 ', 200 + turn, ' ', role) end as text from conversations"


@query(f"with c as ({COMBINED}) select path, pos, coalesce(last_value(case when style = '10' and pos % 10 <> 7 then (200 + pos)::varchar end ignore nulls) over (partition by path order by pos rows unbounded preceding), 'preamble') as standard from c")
def combined_file_split(spark, sf_dir):
    from vellum.sources.ooxml import split_combined

    return split_combined(turns(spark, sf_dir, COMBINED)).select("path", "pos", "standard")


HEADS = "select conv_id as file, turn as line_no, case turn % 4 when 0 then concat('A', conv_id % 3 + 1, ' ', role) when 1 then 'B1 y' when 2 then 'B7 z' else role end as line, case when turn % 7 = 5 then 'A9' end as number, turn % 3 < 2 as candidate from conversations"


@query(f"""with r as (select *, case when candidate and regexp_matches(line, '^[AB][0-9] ') then substr(line, 1, 2) end as head from ({HEADS})), s as (select *, coalesce(head in ('A1', 'B1'), false) as starts, substr(coalesce(head, number), 1, 1) as series from r),
f as (select *, last_value(case when number is not null or starts then series end ignore nulls) over (partition by file order by line_no rows between unbounded preceding and 1 preceding) as in_force from s)
select file, line_no, case when starts or series = in_force then head end as promoted from f""")
def series_promotion(spark, sf_dir):
    """Heads without a period that start a series or go on with one."""
    return normalise.promoted(turns(spark, sf_dir, HEADS)).select("file", "line_no", "promoted")


APPENDICES = "select conv_id as file, turn as line_no, case when turn % 3 = 1 then concat('사례 ', (turn + conv_id) % 3, ' - ', role) else role end as line, turn in (0, 4) as opens, turn in (0, 4) and conv_id % 3 = 1 as reference, turn = 4 and conv_id % 3 = 2 as single_case, turn = 6 as numbered from conversations"


@query(f"""with recursive o as (select *, row_number() over (partition by file order by line_no) as k, nullif(regexp_extract(line, '^사례 ([0-9]+) - ', 1), '')::bigint as n from ({APPENDICES})),
s as (select distinct file, 0::bigint as k, null::bigint as line_no, 1::bigint as cse, null::varchar as pending, 0::bigint as app, 0::bigint as ref, null::varchar as virtual from o
 union all select file, k, line_no, case when hit then cse + 1 else cse end, case when opens then case when reference then '참조' || (ref + 1) when single_case then 'case' else '부록' || (app + 1) end when numbered or eligible then null else pending end,
  app + opens::int, ref + reference::int, case when hit then '부록-사례' || cse when eligible then pending end
  from (select *, eligible and coalesce(n = cse or pending = 'case', false) as hit from (select o.*, s.cse, s.pending, s.app, s.ref, not opens and not numbered and s.app > 0 as eligible from s join o on o.file = s.file and o.k = s.k + 1)))
select file, line_no, virtual from s where k > 0""")
def appendix_virtual_numbers(spark, sf_dir):
    """Appendices, lists of references, lone cases, and cases that open only when they are expected."""
    return normalise.appendix_numbers(turns(spark, sf_dir, APPENDICES)).select("file", "line_no", "virtual")


CELLS_OF_TERMS = "select conv_id as file, turn as line_no, '1' as standard_no, case when turn % 3 = 2 then null when turn % 2 = 0 then 'a' else 'b' end as term, role as definition, turn % 3 = 2 as continues from conversations"


@query(f"""with r as ({CELLS_OF_TERMS}), w as (select file, line_no, coalesce(term = 'b' and lag(term) over (partition by file order by line_no) = 'a', false) as wrap from r where not continues),
g as (select r.*, sum(case when not continues and not coalesce(wrap, false) then 1 else 0 end) over (partition by r.file order by r.line_no rows unbounded preceding) as k from r left join w using (file, line_no))
select file, min(line_no) as line_no, '정의-' || replace(string_agg(term, ' ' order by line_no), ' ', '') as number, string_agg(term, ' ' order by line_no) as term, string_agg(definition, chr(10) || chr(9) order by line_no) as definition from g group by file, k""")
def wrapped_term_cells(spark, sf_dir):
    """Term cells that a table broke over two rows."""
    wraps = spark.createDataFrame([("1", "b", "a")], "standard_no string, fragment string, previous string")
    return normalise.wrapped(turns(spark, sf_dir, CELLS_OF_TERMS), wraps).drop("standard_no")


@query(f"""with e as ({EVENTS}), x as (select * from e union all select file, min(pos) - 1, 'section', null, 'Scope' from e group by file),
s as (select *, last_value(case when kind = 'section' then text end ignore nulls) over (partition by file order by pos rows unbounded preceding) as sec from x),
t as (select *, sec is not null and sec is distinct from lag(sec) over (partition by file order by pos) as new_ from s where kind <> 'section')
select file, count(case when new_ then 1 end) as n_sections, sum(case when new_ then 2 else 0 end + case when kind = 'para' then 2 else 1 end)::bigint as n_lines, min(case when new_ then sec end) as least from t group by file""")
def rebuilt_table_files(spark, sf_dir):
    """Events of a two-column table under an opening section, through the emitter: sections written, lines, the least section."""
    lines = normalise.emitted(normalise.isqm_rebuilt(turns(spark, sf_dir, EVENTS), "Scope"))
    section = F.when(F.col("line").startswith("## "), F.substring("line", 4, 1000))
    return lines.groupBy("file").agg(F.count(section).alias("n_sections"), F.count("*").alias("n_lines"), F.min(section).alias("least"))
