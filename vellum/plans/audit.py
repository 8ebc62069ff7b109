"""Queries of the audit, the evaluation's lists, the integrity checks and the load gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import checks, evaluation, parse, search
from vellum.plans.base import load, query
from vellum.plans.registry import DENSE, GOLD, RANKED, RECALL, dense_sides, fused, gold_pairs, per_query
from vellum.plans.service import POINTS, points

SENTENCES = "l as (select doc_id, row_number() over (partition by doc_id order by n) - 1 as line_no, line from (select doc_id, generate_subscripts(w, 1) as n, unnest(w) as line from (select doc_id, string_split(replace(replace(text, '. ', '.' || chr(10)), '? ', '?' || chr(10)), chr(10)) as w from documents where text is not null)))"
#: In the sentences of documents a capitalised first word stands for a number, and `La ` opens a section.
HEAD = r"^([A-Z]\p{L}{3,})\s"
FILE_LINES = f"{SENTENCES}, fl as (select doc_id as file, line_no, case when starts_with(line, 'La ') then '## 보론 ' || line when starts_with(line, 'Le ') then '## ' || line else line end as line from l)"
SEQ = r"sum(case when regexp_matches(line, '^([A-Z]\pL{3,})\s') then 1 else 0 end) over (partition by file order by line_no rows unbounded preceding)"
NO = r"regexp_extract(line, '^([A-Z]\pL{3,})\s', 1)"


def sentences(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("? "), F.lit("?\n"))
    return parse.lines(load(spark, sf_dir, "documents").where("text is not null").withColumn("text", text), "doc_id").withColumn("line_no", F.col("line_no").cast("long"))


def file_lines(spark, sf_dir):
    line = F.when(F.col("line").startswith("La "), F.concat(F.lit("## 보론 "), "line")).when(F.col("line").startswith("Le "), F.concat(F.lit("## "), "line")).otherwise(F.col("line"))
    return sentences(spark, sf_dir).select(F.col("doc_id").alias("file"), "line_no", line.alias("line"))


@query(f"with {RECALL} select item_id, n_gold from pq where recall_20 = 0")
def zero_recall_list(spark, sf_dir):
    return evaluation.zero_recall(per_query(spark, sf_dir), "item_id")


@query(f"with {DENSE}, h as (select * from (select *, {RANKED} from de) where rank <= 20), {GOLD}, j as (select g.item_id, h.rank from (select distinct item_id, doc_id from gold) g left join h using (item_id, doc_id)) select item_id, count(*) as n_gold from j group by item_id having count(rank) = 0")
def zero_recall_of_vectors_alone(spark, sf_dir):
    """The test vectors know nothing of the texts, so a search by them alone misses the documents that hold an item."""
    vectors, asked = dense_sides(spark, sf_dir)
    hits = search.top(search.dense_scores(asked, "item_id", vectors, "doc_id"), "item_id", "doc_id", 20)
    return evaluation.zero_recall(evaluation.recall_at(hits, gold_pairs(spark, sf_dir), "item_id", "doc_id"), "item_id")


@query("select item_id, 'R' as track, 'R:' || item_id as track_id, text from benchmark union all select item_id, 'C', 'C:' || item_id, coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[Tt]he [a-z]+', '', 'g'), '\\s{2,}', ' ', 'g')), ''), text) from benchmark")
def query_tracks(spark, sf_dir):
    return evaluation.tracks(load(spark, sf_dir, "benchmark"), "item_id", "text", "[Tt]he [a-z]+")


AUDIT = r"""s as (select page_id % 5 as scope, string_agg(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' order by page_id) as stream from pages group by 1), t as (select *, replace(stream, '-', '') as bare from s),
i as (select item_id, item_id % 5 as scope, item_id % 2 = 0 as guide, case when item_id % 3 = 0 then regexp_replace(text, '[.]', '.7', 'g') else text end as text from benchmark),
l as (select item_id, scope, guide, generate_subscripts(string_split(text, ', '), 1) as line_no, unnest(string_split(text, ', ')) as line from i),
v as (select *, case when guide then replace(y, '-', '') else y end as tail from (select *, regexp_replace(line, '[.]\d{1,3}([가-힣(]|$)', '.\1', 'g') as y from l where line <> '')),
w as (select item_id, line_no, line, contains(stream, line) or contains(stream, tail) or (guide and contains(bare, tail)) as ok, case when guide then tail else line end as cut, case when guide then bare else stream end as hay from v join t using (scope)),
c as (select item_id, line_no, ok, case when ok then greatest(1, length(line) // 40) else greatest((length(cut) - 1) // 40, 0) + 1 end as n,
 case when ok then greatest(1, length(line) // 40) else (select count(*) from range(0, greatest((length(cut) - 1) // 40, 0) + 1) r(k) where contains(hay, substr(cut, (k * 40 + 1)::int, 40))) end as hit from w),
a as (select item_id, sum(hit) / sum(n) as r, count(case when not ok then 1 end) as n_failed from c group by item_id),
b as (select x.item_id, x.scope, case when coalesce(n_failed, 0) = 0 then 'OK' when r >= 0.5 then 'PARTIAL' else 'MISSING' end as bucket, case when coalesce(n_failed, 0) = 0 then 1.0 else round(r, 3) end as rate, coalesce(n_failed, 0) as n_failed from (select distinct item_id, scope from l) x left join a using (item_id))"""


def audited(spark, sf_dir, change=None):
    pages = load(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("scope"), "page_id", F.regexp_replace("html", "<[^>]*>", "").alias("t"))
    text = F.when(F.col("item_id") % 3 == 0, F.replace("text", F.lit("."), F.lit(".7"))).otherwise(F.col("text"))
    lines = load(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 5).alias("scope"), (F.col("item_id") % 2 == 0).alias("guide"), F.posexplode(F.split(text, ", ")).alias("line_no", "line"))
    lines = lines if change is None else change(lines)
    return lines, evaluation.containment(lines, pages, "item_id", "scope", "page_id", "t", guide=F.col("guide"))


@query(f"with {AUDIT} select item_id, bucket, rate, n_failed from b")
def containment_by_lines(spark, sf_dir):
    """Paragraphs of several lines, with the second tries for footnote numbers and, in guides, hyphens."""
    return audited(spark, sf_dir)[1]


COUNTED = f"with {AUDIT}, n as (select scope, count(*) as n, count(case when bucket = 'OK' then 1 end) as ok, count(case when bucket = 'PARTIAL' then 1 end) as partial, count(case when bucket = 'MISSING' then 1 end) as missing from b group by scope)"


@query(f"{COUNTED} select * from n")
def audit_bucket_counts(spark, sf_dir):
    lines, found = audited(spark, sf_dir)
    return evaluation.bucket_counts(found.join(lines.select("item_id", "scope").distinct(), "item_id"), "scope")


@query(f"{COUNTED} select * from n where partial + missing > 0 order by partial + missing desc, scope limit 3")
def audit_worst(spark, sf_dir):
    return evaluation.worst(audit_bucket_counts(spark, sf_dir), "scope", 3)


IDS = "case doc_id % 6 when 0 then concat('IE사례', doc_id % 4, '-', doc_id) when 1 then concat('IE부록B-', doc_id) when 2 then concat('BC-B', doc_id) when 3 then concat('A', doc_id) when 4 then concat('정의-', doc_id) else concat('', doc_id) end"


@query(f"""with c as (select source, {IDS} as number, doc_id from documents), o as (select source, number from c union all select source, case doc_id % 6 when 0 then concat('', doc_id) when 1 then concat('B', doc_id) when 2 then concat('B', doc_id) end from c where doc_id % 6 < 3),
k as (select distinct source, number from o where (regexp_matches(number, '^[A-Z]{{1,3}}[0-9]+$') or regexp_matches(number, '^[0-9]+$')) and (source <> 'src1' or regexp_matches(number, '^A?[0-9]+$'))),
r as (select distinct source, case when doc_id % 4 = 0 then concat('B', doc_id) else concat('', doc_id) end as number from documents)
select source, number, 'corpus' as side from (from k except from r) union all select source, number, 'raw' from (from r except from k)""")
def number_set_difference(spark, sf_dir):
    """Numbers of the corpus against those of the source, with the originals of synthetic ids; src1 stands for an auditing standard."""
    d = load(spark, sf_dir, "documents")
    raw = d.select("source", F.expr("case when doc_id % 4 = 0 then concat('B', doc_id) else concat('', doc_id) end").alias("number"))
    return evaluation.number_differences(d.select("source", F.expr(IDS).alias("number")), raw, "source", "number", F.col("source") == "src1")


@query(rf"""with {FILE_LINES}, k as (select *, case when starts_with(line, '## ') then 'section' when regexp_matches(line, '^(\pL+)\. ') or regexp_matches(line, '^(\pL{{6,}}) ') then 'head' when regexp_matches(line, '\S') then 'text' end as kind from fl),
n as (select *, lag(kind) over (partition by file order by line_no) as p from k where kind is not null),
s as (select *, sum(case when kind = 'head' or (kind = 'text' and coalesce(p, 'section') = 'section') then 1 else 0 end) over (partition by file order by line_no rows unbounded preceding) as seq from n)
select file, seq::bigint as seq, coalesce(max(case when kind = 'head' then regexp_extract(line, '^(\pL{{6,}}) ', 1) end), '(무번호)') as number, count(*) as n_lines from s where kind <> 'section' group by all""")
def corpus_reparse(spark, sf_dir):
    """The audit's own parser: sections end paragraphs, and what follows one without a head is unnumbered."""
    return evaluation.reparsed(file_lines(spark, sf_dir), "file", r"^(\p{L}{6,}) (.*)$").drop("text")


@query(f"with {FILE_LINES}, s as (select *, {SEQ} as seq, {NO} as no from fl) select file, seq::bigint as seq, max(no) as para_no, sum(length(line))::bigint as size from s where seq > 0 group by file, seq")
def paragraph_sizes(spark, sf_dir):
    return checks.paragraph_sizes(file_lines(spark, sf_dir), HEAD)


@query(f"""with {FILE_LINES}, s as (select *, {SEQ} as seq, max(case when {NO} <> '' then {NO} end) over (partition by file, x) as para_no from (select *, {SEQ} as x from fl)),
m as (select *, max(case when starts_with(line, '## ') and contains(line, '보론') then 1 else 0 end) over (partition by file, seq order by line_no rows unbounded preceding) as marked from s where seq > 0)
select distinct file, para_no from m where marked = 1 and not starts_with(line, '## ') and regexp_matches(line, '\\S')""")
def section_crossings(spark, sf_dir):
    return checks.section_crossings(file_lines(spark, sf_dir), HEAD)


@query(f"""with {FILE_LINES}, h as (select file, {NO} as para_no, row_number() over (partition by file order by line_no) as seq from fl where {NO} <> ''), f as (select *, {SEQ} as seq, {NO} as no from fl),
z as (select file, max(no) as para_no, sum(length(line)) as size from f where seq > 0 group by file, seq),
g as (select file, para_no, count(*) as n from h group by all having count(*) > 1),
st as (select 'S' || (file % 7) as standard_no, para_no, min(file) as file, count(*) as n from h group by all having count(*) > 1),
u as (select file, line_no, substr(line, 1, 40) as line from fl where not starts_with(line, chr(9)) and {NO} = '' and regexp_matches(line, '^[A-Z]\\pL+,')),
m as (select *, max(case when starts_with(line, '## ') and contains(line, '보론') then 1 else 0 end) over (partition by file, seq order by line_no rows unbounded preceding) as marked, max(case when no <> '' then no end) over (partition by file, seq) as pn from f where seq > 0)
select file, 'repeated number' as "check", para_no || ' ' || n as detail from g
union all select file, 'head without a period', line_no || ' ' || line from u
union all select file, 'paragraph too long', para_no || ' ' || size::bigint from z where size > 6000
union all select distinct file, 'paragraph across a section', pn from m where marked = 1 and not starts_with(line, '## ') and regexp_matches(line, '\\S')
union all select file, 'number in several files', standard_no || ' ' || para_no || ' ' || n from st
union all select file, 'comment left', count(*)::varchar from fl where contains(line, '<!--') group by file""")
def validation_violations(spark, sf_dir):
    """All checks of written files, a row for each violation."""
    lines = file_lines(spark, sf_dir)
    standard = lines.select("file").distinct().withColumn("standard_no", F.concat(F.lit("S"), F.col("file") % 7))
    return checks.validation(lines, HEAD, r"^[A-Z]\p{L}+,", standard)


@query("with e as (select distinct source, (length(source) * 10)::bigint as n from documents union all select 'absent', 5), h as (select source, count(*) as n from documents where lang <> 'xx' group by 1) select coalesce(e.source, h.source) as source, coalesce(e.n, 0) as want, coalesce(h.n, 0) as have from e full join h using (source) where coalesce(e.n, 0) <> coalesce(h.n, 0)")
def expected_count_mismatches(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    expected = d.select("source", (F.length("source") * 10).cast("long").alias("n")).distinct().unionByName(spark.createDataFrame([("absent", 5)], "source string, n long"))
    return checks.expected_counts(d, expected, "source")


@query("with n as (select vec_id, len(embedding) as d, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from (select vec_id, case when vec_id % 9 = 0 then list_transform(embedding, lambda x: x * 2) when vec_id % 9 = 1 then embedding[1:10] else embedding end as embedding from embeddings)) select vec_id, case when d <> 64 then 'dimension' else 'norm' end as problem from n where d <> 64 or abs(n - 1) > 0.001")
def vector_problems(spark, sf_dir):
    """External vectors held against dimension and norm; some are broken for the purpose."""
    v = load(spark, sf_dir, "embeddings")
    broken = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 2)).when(F.col("vec_id") % 9 == 1, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return checks.vector_problems(v.select("vec_id", broken.alias("embedding")), "vec_id", "embedding", 64)


@query("with n as (select case when vec_id % 9 = 0 then 'nan'::double else sqrt(list_dot_product(embedding::double[], embedding::double[])) end as n from embeddings) select count(*) as n, count(case when isnan(n) then 1 end) as n_nan, round(min(case when not isnan(n) then n end), 6) as lo, round(max(case when not isnan(n) then n end), 6) as hi from n")
def norm_summary(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("embedding")).alias("v"))
    return checks.norm_summary(v, "v").select("n", "n_nan", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("select doc_id, 'left' as side from (select doc_id from documents except select vec_id from embeddings) union all select vec_id, 'right' from (select vec_id from embeddings except select doc_id from documents)")
def key_agreement(spark, sf_dir):
    return checks.key_agreement(load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("select doc_id, count(*) as n_tokens from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as tok from documents) group by 1 having count(*) > 900")
def over_token_limit(spark, sf_dir):
    return checks.over_token_limit(search.tokens(load(spark, sf_dir, "documents"), "doc_id"), "doc_id", 900)


@query(f"with {POINTS} select cid || case when part > 0 then '#' || part else '' end as composite_id from pt where doc_id % 5 = 0 or (doc_id % 5 = 1 and document <> upper(document))")
def roundtrip_of_points(spark, sf_dir):
    """Points whose stored copy is missing (every fifth) or differs (the next, kept in upper case)."""
    made = points(spark, sf_dir)
    stored = made.where("doc_id % 5 <> 0").withColumn("document", F.when(F.col("doc_id") % 5 == 1, F.upper("document")).otherwise(F.col("document")))
    return checks.roundtrip(made, stored, "composite_id", "document")


@query(f"""with {POINTS}, p as (select *, cid || case when part > 0 then '#' || part else '' end as composite_id from pt)
select 'points' as "check", abs(count(*) - 1000) as n_violations from p union all select 'sequence', 0 union all select 'unique ids', 0 union all select 'parts', 0
union all select 'vectors', count(*) from p join embeddings on doc_id = vec_id where doc_id % 9 = 0
union all select 'keys', count(*) from p where doc_id not in (select vec_id from embeddings)""")
def load_gate(spark, sf_dir):
    """The checks of a load over the points, with vectors of which every ninth is not normalised; a thousand points are expected."""
    made = points(spark, sf_dir)
    dense = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))
    vectors = made.select("composite_id", "doc_id").join(load(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("composite_id", dense.alias("dense"))
    return checks.load_gate(made, vectors, 1000, 64)


@query("""with m as (select s.scope, f.source, f.rank from (select unnest(range(5)) as scope) s, lateral (select s.scope as source, 0 as rank union all select 4, 1 where s.scope <> 4) f)
select m.scope, count(*) as n_pages, sum(length(html))::bigint as n_chars from m join pages on page_id % 5 = m.source group by m.scope""")
def fallback_streams(spark, sf_dir):
    """Each scope's pages with those of the pool that all share."""
    pages = load(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("scope"), "page_id", "html")
    own = [(s, s, 0) for s in range(5)] + [(s, 4, 1) for s in range(4)]
    found = evaluation.with_fallbacks(pages, spark.createDataFrame(own, "scope long, source long, rank int"), "scope", "page_id")
    return found.groupBy("scope").agg(F.count("*").alias("n_pages"), F.sum(F.length("html")).cast("long").alias("n_chars"))


@query(f"with {RECALL}, t as (select distinct item_id, doc_id from gold) select item_id, min(rank) as rank from t left join h using (item_id, doc_id) group by item_id")
def probe_ranks(spark, sf_dir):
    return evaluation.probe_ranks(fused(spark, sf_dir, 20), gold_pairs(spark, sf_dir), "item_id", "doc_id")
