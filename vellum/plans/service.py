"""Queries of the search service over points made of the documents: a built index, responses, lookups, definitions.

Documents stand for paragraphs; every seventh stands in two parts. Benchmark items are the requests, and their ids
set the filters, so that every branch of the policy is taken, errors included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import index, parse, sql_surface
from vellum.operators import service as S
from vellum.plans.base import load, new_folder, once, query

CODE = "case doc_id % 3 when 0 then 'KIFRS' when 1 then 'KSA' else 'GUIDE' end"
SOURCE_TYPE = "case doc_id % 3 when 0 then '회계기준' when 1 then '감사기준' else '실무지침' end"
STANDARD = "case when doc_id % 11 = 0 then 'CF' when doc_id % 13 = 0 then 'PS2' else coalesce(source, 'none') end"
NUMBER = "case doc_id % 10 when 0 then concat('BC', doc_id) when 1 then concat('IE', doc_id) when 2 then concat('정의-', doc_id) when 3 then concat('참조', doc_id) when 4 then concat('부록', doc_id) when 5 then concat(doc_id, '.1') when 6 then concat('A', doc_id) when 7 then concat('한', doc_id, '.2') when 8 then concat('부록-', doc_id) else concat('', doc_id) end"
BASE = f"""select doc_id, {CODE} as code, {SOURCE_TYPE} as source_type, {STANDARD} as standard_no, lang as standard_title, {NUMBER} as para_no, concat(lang, ' > ', source) as section_path,
 concat({CODE}, '_', lang, '.md') as source_file, coalesce(text, '') as text, doc_id % 7 = 3 and length(coalesce(text, '')) >= 40 as split from documents"""
PARA_TYPE = """case when source_type = '회계기준' and para_no like 'BC%' then '결론도출근거' when source_type = '회계기준' and regexp_matches(para_no, '^I[EG]') then '적용사례' when para_no like '정의-%' then '정의'
 when regexp_matches(para_no, '^참조[0-9]+$') then '참조' when regexp_matches(para_no, '^(부록[0-9]+|부록-사례[0-9]+|사례[A-Z])$') then '부록'
 when source_type = '감사기준' then case when regexp_matches(para_no, '^[0-9]+([.][0-9]+)*$') then '요구사항' else '적용지침' end
 when source_type = '회계기준' then case when regexp_matches(para_no, '^한?[0-9][0-9.]*$') then '본문' else '적용지침' end else '본문' end"""
POINTS = f"""base as (select *, {PARA_TYPE} as para_type, code || '::' || standard_no || '::' || para_no as cid, row_number() over (partition by source_file order by doc_id) as seq from ({BASE})),
pt as (select *, doc_id * 10 as point, text as document, 0 as part from base where not split
 union all select *, doc_id * 10 + 1, substr(text, 1, (length(text) // 2)::int), 1 from base where split
 union all select *, doc_id * 10 + 2, substr(text, (length(text) // 2 + 1)::int), 2 from base where split),
whole as (select cid, any_value(source_file) as source_file, any_value(seq) as seq, any_value(para_type) as para_type, any_value(standard_no) as standard_no, string_agg(document, chr(10) order by part) as text, count(*) as n_parts from pt group by cid)"""
REQUEST = """select item_id as qid, text as query, case when item_id % 6 = 1 then array('src1', 'CF') end as standard_no, case when item_id % 8 = 2 then array('회계기준', '실무지침') when item_id % 40 = 7 then array('other') end as source_type,
 case item_id % 9 when 4 then '적용사례' when 5 then 'nonsense' when 6 then '참조' end as para_type, 1 + item_id % 25 as top_k, item_id % 4 = 0 as include_examples, item_id % 5 = 0 as include_bc, item_id % 3 = 0 as include_framework from benchmark"""
ASKED = f"""rq as ({REQUEST.replace("array('src1', 'CF')", "['src1', 'CF']").replace("array('회계기준', '실무지침')", "['회계기준', '실무지침']").replace("array('other')", "['other']")}),
bad as (select *, length(query) not between 1 and 500 or top_k not between 1 and 20 or coalesce(list_contains(source_type, 'other'), false) or coalesce(para_type = 'nonsense', false) as bad from rq),
ask as (select *, list_filter(case when include_examples then [] else ['부록', '적용사례'] end || case when include_bc then [] else ['결론도출근거'] end, lambda t: t is distinct from para_type) as hide_t,
 list_filter(case when include_framework then [] else ['CF', 'MC', 'PS2'] end, lambda t: not list_contains(coalesce(standard_no, []), t)) as hide_s from bad where not bad)"""
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
HITS = f"""{POINTS}, {ASKED},
t as (select point, unnest({TOKENS.format("document")}) as tok from pt), tf as (select point, tok, count(*) as tf from t group by all), dl as (select point, sum(tf) as dl from tf group by 1), av as (select avg(dl) as avgdl from dl),
post as (select point, tok, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as w from tf join dl using (point), av),
idf as (select tok, ln(((select count(*) from pt) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from tf group by 1),
qt as (select distinct qid, unnest({TOKENS.format("query")}) as tok from ask),
sc as (select 1 as branch, qid, point, round(sum(w * idf), 9) as score from post join qt using (tok) join idf using (tok) group by all
 union all select 2, qid, point, round(list_dot_product(d.embedding::double[], e.embedding::double[]), 9) from ask join embeddings e on qid = e.vec_id, embeddings d join pt on pt.doc_id = d.vec_id),
ok as (select sc.*, list_contains(hide_t, pt.para_type) or list_contains(hide_s, pt.standard_no) as hidden from sc join pt using (point) join ask a using (qid)
 where (len(coalesce(a.standard_no, [])) = 0 or list_contains(a.standard_no, pt.standard_no)) and (len(coalesce(a.source_type, [])) = 0 or list_contains(a.source_type, pt.source_type)) and (a.para_type is null or a.para_type = pt.para_type)),
bo as (select *, true as baseline from ok union all select *, false from ok where not hidden),
rk as (select *, row_number() over (partition by branch, qid, baseline order by score desc, point) as rank from bo),
fu as (select qid, baseline, point, round(sum(1 / (60.0::double + rank)), 9) as score from rk where rank <= 50 group by all),
hit as (select *, row_number() over (partition by qid, baseline order by score desc, point) as rank from fu)"""
RESULTS = f"""{HITS}, lo as (select qid, cid, min(rank) as best, max(score) as score from hit join pt using (point) where not baseline group by all),
re as (select *, row_number() over (partition by qid order by best) as rank from lo)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents").createOrReplaceTempView("vellum_documents")
    base = spark.sql(BASE.replace("from documents", "from vellum_documents"))
    base = base.withColumn("para_type", parse.para_type(F.col("source_type"), F.col("para_no"))).withColumn("cid", parse.composite_id(F.col("code"), F.col("standard_no"), F.col("para_no")))
    numbered = base.select("doc_id", F.row_number().over(Window.partitionBy("source_file").orderBy("doc_id")).cast("long").alias("seq"))  # among narrow rows
    base = base.join(numbered, "doc_id")
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda n, text: F.struct(F.lit(n).cast("long").alias("part_no"), text.alias("document"))
    parts = F.when(F.col("split"), F.array(part(1, F.substring(F.col("text"), F.lit(1), half)), part(2, F.substring(F.col("text"), half + 1, F.length("text"))))).otherwise(F.array(part(None, F.col("text"))))
    rows = base.withColumn("_p", F.explode(parts)).select("*", "_p.part_no", "_p.document")
    return rows.select(
        (F.col("doc_id") * 10 + F.coalesce("part_no", F.lit(0))).alias("point"), F.concat("cid", F.coalesce(F.concat(F.lit("#"), "part_no"), F.lit(""))).alias("composite_id"), "doc_id",
        "source_type", "standard_no", "standard_title", "para_no", "para_type", "section_path", "seq", "source_file", "document", "part_no", F.when(F.col("split"), 2).cast("long").alias("part_total"),
    )


def built(spark: SparkSession, sf_dir: str) -> index.SearchIndex:
    return once(spark, sf_dir, "service-index", lambda path: index.build(points(spark, sf_dir), path, "point", "document"))


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points, written once: lookups need no index."""
    return once(spark, sf_dir, "service-points", lambda path: index.put(points(spark, sf_dir), path))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("vellum_benchmark")
    return spark.sql(REQUEST.replace("from benchmark", "from vellum_benchmark"))


def answers(spark: SparkSession, sf_dir: str):
    made, vectors = built(spark, sf_dir), load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    asked = requests(spark, sf_dir)
    of_points = made.points.select("point", "doc_id").join(vectors, F.col("doc_id") == F.col("vec_id")).select("point", "vec")
    return S.search_points(made, asked, asked.join(vectors, F.col("qid") == F.col("vec_id")).select("qid", "vec"), of_points, new_folder(spark, "hits"))


@query(f"with {RESULTS} select qid, re.rank, cid, re.score, whole.para_type, whole.standard_no, sha256(whole.text) as digest, case when n_parts > 1 then '분할 문단 ' || n_parts || '조각 재조립;' else '' end || case when whole.para_type = '참조' then '발췌 대조표 — 원전 문단 우선 인용;' else '' end as notes from re join whole using (cid) join ask using (qid) where re.rank <= top_k")
def search_response_results(spark, sf_dir):
    """What a search returns: filters, opt-outs, parts put together, notes."""
    found = answers(spark, sf_dir)[0]
    return found.select("qid", "rank", "cid", "score", "para_type", "standard_no", F.sha2("text", 256).alias("digest"), F.array_join(F.transform("notes", lambda n: F.concat(n, F.lit(";"))), "").alias("notes"))


@query(f"""with {HITS}, se as (select qid, count(case when list_contains(hide_t, pt.para_type) and pt.para_type in ('부록', '적용사례') then 1 end) as e, count(case when list_contains(hide_t, pt.para_type) and pt.para_type = '결론도출근거' then 1 end) as b,
 count(case when list_contains(hide_s, pt.standard_no) then 1 end) as f from hit join ask using (qid) join pt using (point) where baseline and rank <= top_k group by qid),
qo as (select qid, i, w[i] as tok from (select qid, w, unnest(range(1, len(w) + 1)) as i from (select qid, {TOKENS.format("query")} as w from ask))),
fo as (select qid, tok, min(i) as i from qo where tok not in (select tok from idf) group by all), oo as (select qid, string_agg(tok, ' ' order by i) as oov, count(*) as n from fo group by qid), kn as (select qid, count(distinct tok) as k from qo group by qid)
select qid, coalesce(e, 0) as examples_excluded, coalesce(b, 0) as bc_excluded, coalesce(f, 0) as framework_excluded, coalesce(oov, '') as oov,
 ((para_type = '적용사례' and not include_examples) is true)::bigint + (not include_framework and list_contains(coalesce(standard_no, []), 'CF'))::bigint + (coalesce(n, 0) >= coalesce(k, 0))::bigint + (coalesce(e, 0) > 0)::bigint + (coalesce(b, 0) > 0)::bigint + (coalesce(f, 0) > 0)::bigint as n_notes
from ask left join se using (qid) left join oo using (qid) left join kn using (qid)""")
def search_response_applied(spark, sf_dir):
    """What a search says of itself: what the opt-outs hid by axis, unknown tokens in order, notes."""
    found = answers(spark, sf_dir)[1]
    return found.select("qid", "examples_excluded", "bc_excluded", "framework_excluded", F.array_join("oov_query_tokens", " ").alias("oov"), F.size("notes").cast("long").alias("n_notes"))


@query(f"with {ASKED} select qid, case when bad then 'INVALID_INPUT' end as code from bad")
def search_argument_errors(spark, sf_dir):
    return S.policy(requests(spark, sf_dir)).select("qid", F.col("error.code").alias("code"))


@query(f"""with {RESULTS}, n as (select qid, count(*) as n, string_agg(cid, ' ' order by re.rank) as cids from re join ask using (qid) where re.rank <= top_k group by qid)
select qid, case when bad then 'INVALID_INPUT' end as code, case when not bad then coalesce(n, 0) end as n_results, case when not bad then coalesce(cids, '') end as cids, case when not bad then to_json(struct_pack(standard_no := standard_no, source_type := source_type, para_type := para_type)) end as filters from bad left join n using (qid)""")
def search_responses(spark, sf_dir):
    """One row a request: its error, or its results, definitions and what was applied."""
    made, vectors = built(spark, sf_dir), load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    asked = requests(spark, sf_dir)
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("vellum_benchmark")
    of_points = made.points.select("point", "doc_id").join(vectors, F.col("doc_id") == F.col("vec_id")).select("point", "vec")
    entries = spark.sql(ENTRIES.replace("from benchmark", "from vellum_benchmark"))
    found = S.search_responses(made, asked, asked.join(vectors, F.col("qid") == F.col("vec_id")).select("qid", "vec"), of_points, entries, new_folder(spark, "hits"))
    filters = F.to_json("applied.filters", {"ignoreNullFields": "false"})
    return found.select("qid", F.col("error.code").alias("code"), F.when(F.col("error").isNull(), F.size("results")).cast("long").alias("n_results"), F.array_join(F.transform("results", lambda r: r["cid"]), " ").alias("cids"), filters.alias("filters"))


LOOKUP = "select item_id as rid, case item_id % 6 when 0 then concat(cid, '#1') when 1 then 'XX::1::2' when 2 then 'KSA::none::9' when 3 then 'KIFRS::1115' else cid end as cid, item_id % 5 as context"


@query(f"""with {POINTS}, rq as ({LOOKUP} from benchmark join base on doc_id = item_id * 3),
er as (select *, case when contains(cid, '#') or (len(string_split(cid, '::')) <> 3) or split_part(cid, '::', 1) not in ('KSA', 'KIFRS', 'GUIDE') or context > 3 then 'INVALID_INPUT' end as code from rq),
own as (select er.*, w.source_file, w.seq from er join whole w using (cid) where code is null), se as (select rid, w.*, w.seq <> own.seq as is_context from own join whole w on w.source_file = own.source_file and abs(w.seq - own.seq) <= context),
pa as (select rid, string_agg(cid, ' ' order by seq) as cids, sha256(string_agg(text, chr(0) order by seq)) as digest, count(case when n_parts > 1 then 1 end) as n_notes from se group by rid)
select rid, coalesce(code, case when cids is null then 'NOT_FOUND' end) as code, cids is not null as found, cids, digest, n_notes from er left join pa using (rid)""")
def get_paragraph(spark, sf_dir):
    """Lookups by composite id with neighbours, and every kind of error."""
    made = built(spark, sf_dir)
    cids = made.points.select("doc_id", F.substring_index("composite_id", "#", 1).alias("cid")).distinct()
    asked = load(spark, sf_dir, "benchmark").join(cids, F.col("doc_id") == F.col("item_id") * 3).selectExpr(*LOOKUP.removeprefix("select ").replace(", case", ";case").replace(", item_id % 5", ";item_id % 5").split(";"))
    found = S.get_paragraph(asked, made.points)
    texts = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\0")
    return found.select("rid", F.col("error.code").alias("code"), "found", F.array_join(F.transform("paragraphs", lambda p: p["cid"]), " ").alias("cids"), F.sha2(texts, 256).alias("digest"), F.size("notes").cast("long").alias("n_notes"))


@query(f"with {POINTS}, t as (select point, unnest({TOKENS.format('document')}) as tok from pt), tf as (select point, tok, count(*) as tf from t group by all) select tok, count(*) as df, round(ln(((select count(*) from pt) - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) as idf, sum(tf)::bigint as tf from tf group by tok")
def built_index_terms(spark, sf_dir):
    """The built index: document frequency, IDF and all occurrences of each token."""
    made = built(spark, sf_dir)
    total = made.postings.groupBy("tok").agg(F.sum("tf").alias("tf"))
    return made.terms.join(total, "tok").select("tok", "df", F.round("idf", 9).alias("idf"), "tf")


ENTRIES = "select item_id as ord, concat('u', item_id % 7, ' v', item_id % 5, ' w', item_id % 11) as term, text as definition, concat('KSA::', item_id % 3, '::', case when item_id % 2 = 0 then '정의-' else 'A' end, item_id) as source_id, concat('', item_id % 3) as standard_no from benchmark"
TERMS = "select item_id as rid, case when item_id % 13 = 5 then null else array(concat('v', item_id % 6), concat('u', item_id % 7, 'v', item_id % 5, 'w', item_id % 11), concat('u1 v1 w', item_id % 12), concat('1w', item_id % 4), 'zz') end as terms, concat('', item_id % 4) as context_standard from benchmark"


@query(f"""with e as ({ENTRIES}), en as (select *, replace(term, ' ', '') as norm, row_number() over (partition by replace(term, ' ', '') order by ord) = 1 as head from e), rq as ({TERMS.replace("array(", "list_value(")}),
a as (select rid, context_standard, i - 1 as pos, terms[i] as raw from (select *, unnest(range(1, len(terms) + 1)) as i from rq where terms is not null)),
h as (select a.rid, a.pos, a.raw, a.context_standard, en.*, case when term = raw then 1 when norm = replace(raw, ' ', '') then 2 when length(replace(raw, ' ', '')) >= 2 and head and list_contains(string_split(term, ' '), replace(raw, ' ', '')) then 3 when length(replace(raw, ' ', '')) >= 2 and contains(norm, replace(raw, ' ', '')) then 4 end as level
 from a join en on contains(norm, replace(raw, ' ', '')) or term = raw),
b as (select *, first_value(struct_pack(l := level, n := case when level > 2 then norm end)) over (partition by rid, pos order by level, case when level > 2 then length(norm) else 0 end, ord) as best from h where level is not null),
-- a level that matches by word or part takes all entries of the norm it picked
m as (select b.rid, b.pos, b.raw, b.context_standard, x.ord, x.term, x.source_id, x.standard_no from (select distinct rid, pos, raw, context_standard, best from b) b join en x on case when b.best.l = 1 then x.term = b.raw when b.best.l = 2 then x.norm = replace(b.raw, ' ', '') else x.norm = b.best.n end),
p as (select *, row_number() over (partition by rid, pos order by standard_no is distinct from context_standard, ord) as k from m),
al as (select rid, pos, string_agg(source_id, ' ' order by ord) as alternates from p where k > 1 group by all)
select a.rid, a.pos::bigint as pos, a.raw, null::varchar as code, p.term as matched, p.source_id as source_cid, alternates from a left join p on p.rid = a.rid and p.pos = a.pos and k = 1 left join al on al.rid = a.rid and al.pos = a.pos
union all select rid, null, null, 'INVALID_INPUT', null, null, null from rq where terms is null""")
def define_terms(spark, sf_dir):
    """Terms by four levels, the context's own entry first, the others as alternates; what is not found has no match."""
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("vellum_benchmark")
    found = S.define_terms(spark.sql(TERMS.replace("from benchmark", "from vellum_benchmark")), spark.sql(ENTRIES.replace("from benchmark", "from vellum_benchmark")))
    return found.select("rid", "pos", "raw", F.col("error.code").alias("code"), "matched", "source_cid", F.array_join(F.transform("alternates", lambda a: a["source_cid"]), " ").alias("alternates"))


@query(f"with {RESULTS} select qid, re.rank, cid, re.score, whole.para_type, whole.standard_no, sha256(whole.text) as digest from re join whole using (cid) join ask using (qid) where re.rank <= top_k")
def sql_search(spark, sf_dir):
    """Searches from SQL: the view of all requests' answers beside the table of requests."""
    made, vectors = built(spark, sf_dir), load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    asked = requests(spark, sf_dir)
    asked.createOrReplaceTempView("vellum_requests")
    of_points = made.points.select("point", "doc_id").join(vectors, F.col("doc_id") == F.col("vec_id")).select("point", "vec")
    sql_surface.register_answers(made, asked, asked.join(vectors, F.col("qid") == F.col("vec_id")).select("qid", "vec"), of_points, new_folder(spark, "hits"), "vellum")
    return spark.sql("select r.qid, s.rank, s.cid, s.score, s.para_type, s.standard_no, sha2(s.text, 256) as digest from vellum_requests r join vellum_answers s on s.qid = r.qid")


@query(f"with {POINTS} select b.item_id, n.seq, n.cid, n.seq <> t.seq as is_context, sha256(n.text) as digest from benchmark b join base d on d.doc_id = b.item_id join whole t on t.cid = d.cid join whole n on n.source_file = t.source_file and abs(n.seq - t.seq) <= b.item_id % 4")
def sql_get_paragraph(spark, sf_dir):
    """Lookups from SQL, each with its own context."""
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("vellum_benchmark")
    stored = stored_points(spark, sf_dir)
    sql_surface.register_paragraphs(spark, stored, "vellum")
    stored.select("doc_id", F.substring_index("composite_id", "#", 1).alias("cid")).distinct().createOrReplaceTempView("vellum_cids")
    return spark.sql("select b.item_id, p.seq, p.cid, p.is_context, sha2(p.text, 256) as digest from vellum_benchmark b join vellum_cids c on c.doc_id = b.item_id, lateral vellum_get_paragraph(c.cid, cast(b.item_id % 4 as int)) p")


@query(f"""with e as ({ENTRIES}), en as (select *, replace(term, ' ', '') as norm, row_number() over (partition by replace(term, ' ', '') order by ord) = 1 as head from e),
a as (select distinct w.raw, item_id % 4 as ctx from benchmark, lateral (select unnest([concat('v', item_id % 6), concat('u', item_id % 7, ' v', item_id % 5, ' w', item_id % 11), concat('1w', item_id % 4), 'zz']) as raw) w),
h as (select a.*, en.*, case when term = raw then 1 when norm = replace(raw, ' ', '') then 2 when length(replace(raw, ' ', '')) >= 2 and head and list_contains(string_split(term, ' '), replace(raw, ' ', '')) then 3 when length(replace(raw, ' ', '')) >= 2 and contains(norm, replace(raw, ' ', '')) then 4 end as level from a, en),
b as (select *, min(level) over (partition by raw, ctx) as l, first_value(norm) over (partition by raw, ctx order by level, case when level > 2 then length(norm) else 0 end, ord) as picked from h where level is not null)
select raw, ctx::varchar as ctx, row_number() over (partition by raw, ctx order by standard_no is distinct from ctx::varchar, ord) as place, source_id from b where (l < 3 and level = l) or (l > 2 and norm = picked)""")
def sql_define_term(spark, sf_dir):
    """Definitions from SQL: the entries of the first level that matches, the context's own first."""
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("vellum_benchmark")
    sql_surface.register_terms(spark, spark.sql(ENTRIES.replace("from benchmark", "from vellum_benchmark")), "vellum")
    asked = "select distinct raw, string(item_id % 4) as ctx from vellum_benchmark lateral view explode(array(concat('v', item_id % 6), concat('u', item_id % 7, ' v', item_id % 5, ' w', item_id % 11), concat('1w', item_id % 4), 'zz')) x as raw"
    return spark.sql(f"select a.raw, a.ctx, d.place, d.source_id from ({asked}) a, lateral vellum_define_term(a.raw, a.ctx) d")


HEADS = "l as (select doc_id, row_number() over (partition by doc_id order by n) - 1 as line_no, line from (select doc_id, generate_subscripts(w, 1) as n, unnest(w) as line from (select doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) as w from documents where text is not null)))"


@query(f"""with {HEADS}, k as (select *, regexp_extract(line, '^([A-Z]\\pL+)\\s', 1) as no from l), s as (select *, sum(case when no <> '' then 1 else 0 end) over (partition by doc_id order by line_no rows unbounded preceding) as seq from k),
t as (select *, max(case when trim(line) <> '' then line_no end) over (partition by doc_id, seq) as z from s where seq > 0),
p as (select doc_id, seq, max(no) as para_no, string_agg(case when no <> '' then regexp_replace(line, '^([A-Z]\\pL+)\\s', '') else line end, chr(10) order by line_no) as document from t where line_no <= z group by doc_id, seq)
select doc_id, seq::bigint as seq, 'KSA::' || doc_id || '::' || para_no as composite_id, para_no, sha256(document) as digest, length(document)::bigint as char_len from p""")
def paragraph_identity(spark, sf_dir):
    """Heads cut into number and text, and composite ids: each sentence is a line, its capitalised first word the number."""
    head = r"^([A-Z]\p{L}+)\s"
    rows = parse.lines(load(spark, sf_dir, "documents").where("text is not null").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n"))), "doc_id")
    rows = parse.classified(rows, F.col("line").rlike(head), F.lit(False))
    found = parse.paragraphs(rows, "doc_id", F.col("line"), head)
    return found.select("doc_id", "seq", parse.composite_id(F.lit("KSA"), F.col("doc_id").cast("string"), F.col("para_no")).alias("composite_id"), "para_no", F.sha2("document", 256).alias("digest"), "char_len")


SPLIT = "tg as (select doc_id, ord, marker from (select doc_id, text, unnest([1, 2]) as ord, unnest(['The ', 'A']) as marker from documents where text is not null) union all select -1, 1, 'x')"


@query(f"""with {SPLIT}, l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents where text is not null),
c as (select tg.doc_id, ord, min(case when starts_with(trim(line), marker) then line_no end) as cut from tg left join l using (doc_id) group by all),
b as (select *, lag(cut) over (partition by doc_id order by ord) as before_ from c),
f as (select doc_id, case when cut is null then 'marker not found' when cut = 0 then 'cut at the first line' when cut <= before_ then 'cuts out of order' end as reason from b),
u as (select distinct doc_id, cut from c where cut > 0), j as (select l.doc_id, line_no, line, 1 + count(u.cut) filter (u.cut <= line_no) as part from l join u using (doc_id) group by all),
q as (select doc_id, part, rtrim(string_agg(line, chr(10) order by line_no), ' ') as d from j group by all)
select distinct 'D' || doc_id as composite_id, reason from f where reason is not null union select 'D-1', 'paragraph not found' union select 'D' || doc_id, 'empty part' from q where not regexp_matches(d, '\\S')""")
def split_target_failures(spark, sf_dir):
    """Targets that cannot be cut as asked, with the reason."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("D"), "doc_id").alias("composite_id"), F.col("text").alias("document"), "doc_id")
    marks = docs.select("composite_id", F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(m).alias("marker")) for o, m in ((1, "The "), (2, "A"))))).alias("t")).select("composite_id", "t.*")
    marks = marks.unionByName(spark.createDataFrame([("D-1", 1, "x")], "composite_id string, ord int, marker string"))
    return parse.split_targets(docs.drop("doc_id"), marks)[1]
