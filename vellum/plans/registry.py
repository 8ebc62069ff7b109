"""Every query by name over the driver's tables, with the SQL of its oracle.

Documents stand for files, their lines for paragraph lines; `source` and `lang` are the filter axes,
benchmark items the queries, and vectors 0, 1, ... stand in for query vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import checks, dense, evaluation, fingerprint, glossary, index, parse, search
from vellum.operators.containment import contained
from vellum.plans import more_sql
from vellum.plans.base import known, load, new_folder, once, query, sql_of

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # the RFC's namespace for URLs
WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(known)


def oracle_sql() -> dict[str, str]:
    return dict(sql_of)


# ---- lines and paragraphs

LINES = """l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
k as (select *, case when regexp_matches(line, '^[A-Z][a-z]+ ') then 'head' when contains(line, ' | ') then 'section' when trim(line) <> '' then 'text' else 'blank' end as kind from l)"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.lines(load(spark, sf_dir, "documents"), "doc_id")
    return parse.classified(rows, F.col("line").rlike("^[A-Z][a-z]+ "), F.col("line").contains(" | "))


def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.paragraphs(doc_lines(spark, sf_dir), "doc_id", F.col("line"))


@query(f"with {LINES} select doc_id, line_no::bigint as line_no, kind, length(line)::bigint as n from k")
def parse_lines_classified(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", F.length("line").cast("long").alias("n"))


PARAGRAPHS = f"""{LINES},
s as (select *, sum(case when kind = 'head' then 1 else 0 end) over (partition by doc_id order by line_no rows unbounded preceding) as seq,
  last_value(case when kind = 'section' then line end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as sec from k),
t as (select *, max(case when kind in ('head', 'text') then line_no end) over (partition by doc_id, seq) as last_text,
  last_value(case when kind <> 'blank' then kind end ignore nulls) over (partition by doc_id, seq order by line_no rows between unbounded preceding and 1 preceding) as before_kind from s where seq > 0),
p as (select doc_id, seq::bigint as seq, max(case when kind = 'head' then sec end) as section_path, string_agg(line, chr(10) order by line_no) as document,
  bool_or(regexp_matches(line, '^\\s*[|]')) as has_table from t where line_no <= last_text and not (kind = 'blank' and coalesce(before_kind, '') = 'section') group by doc_id, seq)"""


@query(f"with {PARAGRAPHS} select doc_id, seq, section_path, sha256(document) as digest, has_table, length(document)::bigint as char_len from p")
def paragraph_table(spark, sf_dir):
    return doc_paragraphs(spark, sf_dir).select("doc_id", "seq", "section_path", F.sha2("document", 256).alias("digest"), "has_table", "char_len")


@query(f"with {LINES} select doc_id, line_no::bigint as line_no, last_value(case when kind = 'section' then line end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as section from k")
def section_carry_forward(spark, sf_dir):
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.last(F.when(F.col("kind") == "section", F.col("line")), True).over(upto).alias("section"))


TYPE_NO = "case doc_id % 10 when 0 then 'BC' || doc_id when 1 then 'IE' || doc_id when 2 then '정의-' || lang when 3 then '참조' || doc_id when 4 then '부록' || doc_id when 5 then doc_id || '.1' when 6 then 'A' || doc_id when 7 then '한' || doc_id || '.2' when 8 then '부록-' || doc_id else doc_id::varchar end"
TYPE_ST = "case doc_id % 3 when 0 then '회계기준' when 1 then '감사기준' else '실무지침' end"


@query(f"""with d as (select doc_id, {TYPE_NO} as p, {TYPE_ST} as st from documents)
select doc_id, case when st = '회계기준' and p like 'BC%' then '결론도출근거' when st = '회계기준' and regexp_matches(p, '^I[EG]') then '적용사례' when p like '정의-%' then '정의'
 when regexp_matches(p, '^참조[0-9]+$') then '참조' when regexp_matches(p, '^(부록[0-9]+|부록-사례[0-9]+|사례[A-Z])$') then '부록'
 when st = '감사기준' then case when regexp_matches(p, '^[0-9]+([.][0-9]+)*$') then '요구사항' else '적용지침' end
 when st = '회계기준' then case when regexp_matches(p, '^한?[0-9][0-9.]*$') then '본문' else '적용지침' end else '본문' end as para_type from d""")
def para_type_case(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(TYPE_NO.replace("doc_id::varchar", "string(doc_id)").replace("|| doc_id", "|| string(doc_id)").replace("then doc_id ||", "then string(doc_id) ||")).alias("p"), F.expr(TYPE_ST).alias("st"))
    return d.select("doc_id", parse.para_type(F.col("st"), F.col("p")).alias("para_type"))


@query(f"""with {LINES}, m as (select *, min(case when starts_with(ltrim(line), 'The ') then line_no end) over (partition by doc_id) as cut from l),
p as (select doc_id, case when cut > 0 and line_no >= cut then 1 else 0 end as part, line_no, line from m),
j as (select doc_id, part, rtrim(string_agg(line, chr(10) order by line_no)) as document from p group by doc_id, part)
select doc_id, row_number() over (partition by doc_id order by part) as part_no, count(*) over (partition by doc_id) as part_total, sha256(document) as digest from j where document <> ''""")
def marker_split(spark, sf_dir):
    rows = parse.lines(load(spark, sf_dir, "documents"), "doc_id")
    return parse.split_at(rows, "doc_id", F.when(F.ltrim("line").startswith("The "), 1)).select("doc_id", "part_no", "part_total", F.sha2("document", 256).alias("digest"))


@query(f"with {LINES}, g as (select doc_id, line_no // 5 as part, string_agg(line, chr(10) order by line_no) as d from l group by 1, 2) select doc_id, sha256(string_agg(d, chr(10) order by part)) as digest, count(*) as n_parts from g group by doc_id")
def reassemble_fragments(spark, sf_dir):
    rows = parse.lines(load(spark, sf_dir, "documents"), "doc_id").withColumn("part_no", F.floor(F.col("line_no") / 5))
    parts = rows.groupBy("doc_id", "part_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("document"))
    return parse.reassembled(parts, "doc_id").select("doc_id", F.sha2("document", 256).alias("digest"), "n_parts")


@query("select doc_id, sha256(lang || ' ' || source || ' | ' || source || ' (1/2)' || case when lang = 'fr' then ' · example' else '' end || ' | ' || text) as digest from documents")
def synthetic_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    made = parse.synthetic_text(F.concat_ws(" ", "lang", "source"), F.col("source"), F.col("text"), F.lit(1), F.lit(2), F.when(F.col("lang") == "fr", " · example"))
    return d.select("doc_id", F.sha2(made, 256).alias("digest"))


# ---- scalar functions


@query(f"""with h as (select doc_id, sha1(from_hex('{NAMESPACE.replace("-", "")}') || encode('DOC::' || doc_id)) as h from documents)
select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h""")
def uuid5_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.uuid5(NAMESPACE, F.concat(F.lit("DOC::"), F.col("doc_id").cast("string"))).alias("id"))


@query("""with a as (select doc_id::varchar as key, case when doc_id % 17 = 3 then upper(text) else text end as text from documents where doc_id % 13 <> 5), b as (select doc_id::varchar as key, text from documents where doc_id % 11 <> 4)
select coalesce(a.key, b.key) as key, case when a.key is null then 'added' when b.key is null then 'removed' else 'changed' end as change from a full join b on a.key = b.key where a.key is null or b.key is null or a.text is distinct from b.text""")
def corpus_changes(spark, sf_dir):
    """An older state of the corpus against the present one, by their hash trees: some documents added, some removed, some in other words."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    older = docs.where("doc_id % 13 <> 5").withColumn("text", F.when(F.col("doc_id") % 17 == 3, F.upper("text")).otherwise(F.col("text")))
    trees = [fingerprint.write_tree(rows, new_folder(spark, "tree"), "doc_id", "text") for rows in (older, docs.where("doc_id % 11 <> 4"))]
    return fingerprint.changed(*trees)


@query("select source, substr(sha256(string_agg(text, chr(0) order by doc_id)), 1, 16) as fingerprint from documents group by source")
def content_fingerprint(spark, sf_dir):
    return fingerprint.per_group(load(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("select doc_id, n_chars // 40 + case when n_chars % 40 > 0 then 1 else 0 end as n_chunks, sha256(array_to_string(list_transform(range((length(text) + 39) // 40), lambda i: substr(text, (i * 40 + 1)::int, 40)), chr(0))) as digest from documents where n_chars > 0")
def chunk_fixed_width(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", T.chunks(F.col("text")).alias("c")).select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.array_join("c", "\0").cast("binary"), 256).alias("digest"))


@query("select doc_id, i as chunk_no, substr(text, i * 40 + 1, 40) as chunk from (select doc_id, text, unnest(range((length(text) + 39) // 40)) as i from documents where length(text) > 0)")
def chunk_fixed_width_every_chunk(spark, sf_dir):
    """Every chunk of a text with its position, where chunk_fixed_width has their number and a digest."""
    d = load(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query("select vec_id, sqrt(list_dot_product(embedding::double[], embedding::double[])) > 0.999 and sqrt(list_dot_product(embedding::double[], embedding::double[])) < 1.001 as unit from embeddings")
def l2_norm_check(spark, sf_dir):
    n = T.l2_norm(F.col("embedding"))
    return load(spark, sf_dir, "embeddings").select("vec_id", ((n > 0.999) & (n < 1.001)).alias("unit"))


@query("select doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::bigint as cnt from documents")
def occurrence_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.occurrences(F.lower("text"), F.lit("the")).alias("cnt"))


@query("select item_id, coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[Tt]he [a-z]+', '', 'g'), '\\s{2,}', ' ', 'g')), ''), text) as stripped from benchmark")
def leak_strip(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", T.strip_pattern(F.col("text"), "[Tt]he [a-z]+").alias("stripped"))


@query("select page_id, list_transform(regexp_extract_all(url, '[0-9]+'), lambda x: x::bigint) as numbers from pages")
def number_tuples(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.number_tuple(F.col("url")).alias("numbers"))


@query("select doc_id, round(1 - length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) / length(text), 9) as share from documents where length(text) > 0")
def ascii_share(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.round(T.ascii_share(F.col("text")), 9).alias("share"))


@query("select item_id, regexp_replace(trim(regexp_replace(replace(text, '*', ''), '\\s+', ' ', 'g')), '\\s+', '', 'g') as norm from benchmark")
def gloss_norm(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", T.gloss_norm(F.col("text")).alias("norm"))


@query("select source, nullif(regexp_extract(upper(source), '^한?([A-Z]+)', 1), '') as series, substr(source, 1, 3) as head, count(*) as n from documents group by all")
def para_series(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source", T.para_series(F.upper("source")).alias("series"), F.substring("source", 1, 3).alias("head")).agg(F.count("*").alias("n"))


@query(more_sql.NORMS)
def norm_nfkc(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", T.audit_norm(F.col("text")).alias("norm"), T.markdown_norm(F.concat(F.lit("| **"), F.col("text"), F.lit("** |"))).alias("line"))


# ---- retrieval

TF = f"""t as (select doc_id, unnest({WORDS}) as tok from documents), tf as (select doc_id, tok, count(*) as tf from t group by all),
dl as (select doc_id, sum(tf) as dl from tf group by 1), av as (select avg(dl) as avgdl from dl),
post as (select doc_id, tok, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as w from tf join dl using (doc_id), av),
idf as (select tok, count(*) as df, ln(((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from post group by 1),
q as (select distinct item_id, unnest({WORDS}) as tok from benchmark),
sp as (select item_id, doc_id, round(sum(w * idf), 9) as score from post join q using (tok) join idf using (tok) group by all)"""


def corpus(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    posted = search.postings(docs, "doc_id")
    return docs, posted, search.document_frequency(posted, docs.agg(F.count("*").alias("n")))


def dense_sides(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    return v.select(F.col("vec_id").alias("doc_id"), "vec"), load(spark, sf_dir, "benchmark").join(v, F.col("item_id") == F.col("vec_id")).select("item_id", "vec")


def doc_index(spark, sf_dir) -> index.SearchIndex:
    """Built once; the searches below read its buckets and never the documents."""
    docs = load(spark, sf_dir, "documents")
    return once(spark, sf_dir, "doc-index", lambda path: index.build(docs, path, "doc_id", "text", payload=["doc_id", "lang", "source"], order=["lang"]))


def sparse_top(spark, sf_dir):
    return doc_index(spark, sf_dir).top(search.tokens(load(spark, sf_dir, "benchmark"), "item_id").distinct(), "item_id").select("item_id", "doc_id", "rank", "score")


@query(f"with {TF} select doc_id, tok, round(w, 9) as w from post")
def postings_bm25_weights(spark, sf_dir):
    return search.postings(load(spark, sf_dir, "documents"), "doc_id").select("doc_id", "tok", F.round("w", 9).alias("w"))


@query(f"with {TF} select tok, df, round(idf, 9) as idf from idf")
def df_idf_table(spark, sf_dir):
    return corpus(spark, sf_dir)[2].withColumn("idf", F.round("idf", 9))


@query(f"with {TF} select count(*) as n_docs, round(avg(dl), 4) as avgdl from dl")
def doc_length_avgdl(spark, sf_dir):
    dl = search.lengths(search.tokens(load(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    return dl.agg(F.count("*").alias("n_docs"), F.bround(F.avg("dl"), 4).alias("avgdl"))


@query(f"with {TF}, v as (select distinct tok from t) select tok, (row_number() over (order by tok) - 1)::bigint as idx from v")
def vocab_ids(spark, sf_dir):
    return search.vocabulary(search.tokens(load(spark, sf_dir, "documents"), "doc_id"), new_folder(spark, "vocabulary"))


@query(f"with {TF} select distinct item_id, tok from q where tok not in (select tok from idf)")
def oov_tokens(spark, sf_dir):
    found = doc_index(spark, sf_dir).out_of_vocabulary(search.ordered_tokens(load(spark, sf_dir, "benchmark"), "item_id"), "item_id")
    return found.select("item_id", F.explode("oov").alias("tok"))


RANKED = "row_number() over (partition by item_id order by score desc, doc_id) as rank"
DENSE = "de as (select item_id, d.vec_id as doc_id, round(list_dot_product(d.embedding::double[], e.embedding::double[]), 9) as score from benchmark join embeddings e on item_id = e.vec_id, embeddings d)"


@query(f"with {TF}, r as (select *, {RANKED} from sp) select item_id, doc_id, rank, score from r where rank <= 50")
def bm25_topk(spark, sf_dir):
    """From the blocks of postings whose bounds can reach a query's best 50."""
    return sparse_top(spark, sf_dir)


@query(f"with {TF}, r as (select *, {RANKED} from sp) select item_id, doc_id, rank, score from r where rank <= 50")
def bm25_topk_pruned(spark, sf_dir):
    """bm25_topk from the blocks of postings whose bounds can reach a query's best 50, as a large index is searched."""
    asked = search.tokens(load(spark, sf_dir, "benchmark"), "item_id").distinct()
    return doc_index(spark, sf_dir).top(asked, "item_id", prune=True).select("item_id", "doc_id", "rank", "score")


def revised_index(spark, sf_dir) -> index.SearchIndex:
    """The index of documents grown by batches: a third first, then a third of which some were other texts and some are to go, then the rest with these texts set right, and deletes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")

    def grow(path: str) -> index.SearchIndex:
        early = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("the draft of "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
        made = index.build(docs.where("doc_id % 3 = 0").withColumn("text", early), path, "doc_id", "text", payload=["doc_id", "lang", "source"], order=["lang"])
        made = made.upsert(docs.where("doc_id % 3 = 1").withColumn("text", early), epoch=("daily", 1))
        rest = docs.where("doc_id % 3 = 2 or doc_id % 4 = 0")
        made = made.upsert(rest, docs.where("doc_id % 5 = 0 and doc_id % 3 <> 2 and doc_id % 4 <> 0"), epoch=("daily", 2))
        return made.upsert(rest, epoch=("daily", 2))  # comes again, changes nothing

    return once(spark, sf_dir, "revised-index", grow)


LEFT = "with documents as (select * from documents where not (doc_id % 5 = 0 and doc_id % 3 <> 2 and doc_id % 4 <> 0)), "


@query(f"{LEFT}{TF}, r as (select *, {RANKED} from sp) select item_id, doc_id, rank, score from r where rank <= 50")
def bm25_topk_after_upserts(spark, sf_dir):
    """The same search over an index of several segments with tombstones: what one built at once would give."""
    asked = search.tokens(load(spark, sf_dir, "benchmark"), "item_id").distinct()
    return revised_index(spark, sf_dir).top(asked, "item_id", prune=True).select("item_id", "doc_id", "rank", "score")


@query(f"{LEFT}{TF} select tok, df, round(idf, 9) as idf from idf")
def index_terms_after_compaction(spark, sf_dir):
    """Document frequencies of the grown index once its segments are one."""
    return revised_index(spark, sf_dir).compact(most=1).terms.select("tok", "df", F.round("idf", 9).alias("idf"))


@query(f"with {DENSE}, r as (select *, {RANKED} from de) select item_id, doc_id, rank, score from r where rank <= 50")
def dense_topk(spark, sf_dir):
    vectors, asked = dense_sides(spark, sf_dir)
    return search.top(search.dense_scores(asked, "item_id", vectors, "doc_id"), "item_id", "doc_id").select("item_id", "doc_id", "rank", "score")


@query("""with s as (select b.item_id, d.vec_id as doc_id, round(list_dot_product(d.embedding::double[], e.embedding::double[]), 9) as score from benchmark b join embeddings e on b.item_id = e.vec_id, embeddings d),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) select item_id, doc_id, score from r where rank = 1""")
def dense_index_nearest(spark, sf_dir):
    """The nearest vector by the index of sign patterns: a query visits its own code first, so what equals it is found for sure."""
    vectors, asked = dense_sides(spark, sf_dir)
    made = once(spark, sf_dir, "dense-index", lambda path: dense.build(vectors, path, "doc_id"))
    return made.top(asked, "item_id", 1).select("item_id", "doc_id", "score")


def fused_sql(where: str = "true", dense: bool = True) -> str:
    branches = ["select item_id, doc_id, rank from a where rank <= 50"] + ["select item_id, doc_id, rank from b where rank <= 50"] * dense
    return f"""with {TF}, {DENSE}, ok as (select doc_id from documents where {where}), a as (select *, {RANKED} from sp where doc_id in (select doc_id from ok)),
b as (select *, {RANKED} from de where {"doc_id in (select doc_id from ok)" if where != "true" else "true"}), u as ({" union all ".join(branches)}),
f as (select item_id, doc_id, round(sum(1 / (60.0::double + rank)), 9) as score from u group by all), r as (select *, {RANKED} from f) select item_id, doc_id, rank, score from r where rank <= 10"""


def fused(spark, sf_dir, k=10, must=None, must_not=None):
    vectors, asked = dense_sides(spark, sf_dir)
    return index.hybrid(doc_index(spark, sf_dir), load(spark, sf_dir, "benchmark"), "item_id", vectors, asked, k, must, must_not).select("item_id", "doc_id", "rank", "score")


@query(fused_sql())
def rrf_hybrid_topk(spark, sf_dir):
    return fused(spark, sf_dir)


@query(fused_sql("lang in ('en', 'fr') and source not in ('src1', 'src2')"))
def rrf_filtered(spark, sf_dir):
    return fused(spark, sf_dir, must={"lang": ["en", "fr"]}, must_not={"source": ["src1", "src2"]})


@query(fused_sql(dense=False))
def rrf_sparse_only_when_no_dense(spark, sf_dir):
    return search.fuse([sparse_top(spark, sf_dir)], "item_id", "doc_id", 10).select("item_id", "doc_id", "rank", "score")


@query(f"with h as ({fused_sql()}) select item_id, count(*) as n_hits, count(case when lang in ('de', 'es') then 1 end) as n_excluded from h join documents using (doc_id) group by item_id")
def search_exclusion_counts(spark, sf_dir):
    return search.exclusion_counts(fused(spark, sf_dir), "item_id", doc_index(spark, sf_dir).points, "doc_id", F.col("lang").isin("de", "es"))


@query(f"with h as ({fused_sql().replace('rank <= 10', 'rank <= 100')}), r as (select *, doc_id // 10 as logical, row_number() over (partition by item_id, doc_id // 10 order by rank) as n from h), o as (select *, row_number() over (partition by item_id order by rank) as place from r where n = 1) select item_id, logical, doc_id, rank from o where place <= 10")
def logical_dedupe(spark, sf_dir):
    """The best hit of each logical paragraph, before the limit of ten."""
    return search.one_per_logical(fused(spark, sf_dir, 2 * search.PREFETCH), "item_id", F.floor(F.col("doc_id") / 10).cast("long"), 10).select("item_id", "logical", "doc_id", "rank")


@query("with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as seq from conversations) select a.conv_id, a.seq as target_seq, b.seq, b.seq <> a.seq as is_context from c a join c b on a.conv_id = b.conv_id and abs(a.seq - b.seq) <= 1")
def context_neighbors(spark, sf_dir):
    """Every turn with the one before and the one after it."""
    c = load(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("seq"))
    return search.context(c, c, "conv_id", 1).select("conv_id", "target_seq", "seq", "is_context")


@query("with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as seq from conversations) select a.conv_id, a.seq as target_seq, b.seq, b.seq <> a.seq as is_context from c a join c b on a.conv_id = b.conv_id and abs(a.seq - b.seq) <= 2")
def context_neighbors_every_turn(spark, sf_dir):
    """As many as two on either side."""
    c = load(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("seq"))
    return search.context(c, c, "conv_id", 2).select("conv_id", "target_seq", "seq", "is_context")


@query("select doc_id, lang, source, length(text)::bigint as n from documents where doc_id in (3, 5, 8, 13) or doc_id = 21")
def point_lookup(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(F.col("doc_id").isin(3, 5, 8, 13, 21)).select("doc_id", "lang", "source", F.length("text").cast("long").alias("n"))


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 5")
def topk_longest(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)


# ---- evaluation

GOLD = "gold as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"
RECALL = f"""h as ({fused_sql().replace("rank <= 10", "rank <= 20")}), {GOLD}, j as (select g.item_id, h.rank from (select distinct item_id, doc_id from gold) g left join h using (item_id, doc_id)),
pq as (select item_id, count(*) as n_gold, round(count(case when rank <= 5 then 1 end) / count(*), 9) as recall_5, round(count(case when rank <= 10 then 1 end) / count(*), 9) as recall_10, round(count(case when rank <= 20 then 1 end) / count(*), 9) as recall_20, min(rank) as first_rank from j group by item_id)"""


def gold_pairs(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("_b"))
    return contained(load(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", items, "_b").select("item_id", "doc_id")


def per_query(spark, sf_dir):
    return evaluation.recall_at(fused(spark, sf_dir, 20), gold_pairs(spark, sf_dir), "item_id", "doc_id")


@query(f"with {GOLD} select distinct item_id, doc_id from gold")
def gold_by_containment(spark, sf_dir):
    """The documents that hold an item word for word."""
    return gold_pairs(spark, sf_dir)


@query(f"with {RECALL} select * from pq")
def recall_per_query(spark, sf_dir):
    return per_query(spark, sf_dir)


@query(f"with {RECALL} select round(avg(recall_10), 4) as macro_recall, round(sum(recall_10 * n_gold) / sum(n_gold), 4) as micro_recall, round(avg(coalesce(1 / first_rank, 0)), 4) as mrr, count(*) as n_queries from pq")
def recall_macro_micro_mrr(spark, sf_dir):
    return evaluation.summary(per_query(spark, sf_dir))


@query(f"with h as ({fused_sql()}), {GOLD} select distinct item_id, doc_id from h join gold using (item_id, doc_id)")
def gold_intersection(spark, sf_dir):
    return fused(spark, sf_dir).select("item_id", "doc_id").intersect(gold_pairs(spark, sf_dir))


CITED = "c as (select conv_id, turn, 'see KSA::' || (conv_id % 7) || '::A' || turn || ', KIFRS::' || (turn % 3) || '::BC1; KSA::' || (conv_id % 7) || '::2' as text from conversations)"


def cited_text() -> Column:
    return F.expr("concat('see KSA::', conv_id % 7, '::A', turn, ', KIFRS::', turn % 3, '::BC1; KSA::', conv_id % 7, '::2')")


@query(f"with {CITED}, x as (select conv_id, unnest(regexp_extract_all(text, '(KSA|KIFRS|GUIDE)::([A-Za-z0-9.-]+)::', 0)) as m from c) select distinct conv_id, replace(rtrim(m, ':'), '::', ':') as code from x")
def citation_extract(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", F.explode(T.citations(cited_text())).alias("code")).distinct()


@query(f"""with {CITED}, x as (select conv_id, unnest(regexp_extract_all(text, '(KSA|KIFRS|GUIDE)::([A-Za-z0-9.-]+)::', 0)) as m from c), e as (select distinct conv_id, replace(rtrim(m, ':'), '::', ':') as code from x),
g as (select distinct conv_id, 'KSA:' || (conv_id % 5) as code from conversations), b as (select coalesce(g.conv_id, e.conv_id) as conv_id, g.code as gc, e.code as ec from g full join e on g.conv_id = e.conv_id and g.code = e.code)
select conv_id, count(gc) as n_gold, count(case when gc is not null and ec is not null then 1 end) as n_hit, count(case when gc is null then 1 end) as n_extra, round(count(case when gc is not null and ec is not null then 1 end) / count(gc), 4) as recall,
 coalesce(string_agg(case when gc is not null and ec is not null then gc end, ' ' order by gc), '') as hit, coalesce(string_agg(case when ec is null then gc end, ' ' order by gc), '') as missed, coalesce(string_agg(case when gc is null then ec end, ' ' order by ec), '') as extra from b group by conv_id""")
def citation_recall(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    cited = c.select("conv_id", F.explode(T.citations(cited_text())).alias("code"))
    found = evaluation.cited_recall(c.select("conv_id", F.expr("concat('KSA:', conv_id % 5)").alias("code")), cited, "conv_id", "code")
    return found.withColumns({x: F.array_join(x, " ") for x in ("hit", "missed", "extra")})


@query("""with s as (select page_id % 5 as scope, string_agg(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' order by page_id) as stream from pages group by 1),
l as (select item_id, text as line, stream from benchmark left join s on item_id % 5 = scope where text <> ''),
n as (select *, coalesce(contains(stream, line), false) as there from l),
c as (select item_id, there, case when there then greatest(1, length(line) // 40) else (length(line) - 1) // 40 + 1 end as n,
 case when there then greatest(1, length(line) // 40) else (select count(*) from range(0, (length(line) - 1) // 40 + 1) t(i) where contains(coalesce(stream, ''), substr(line, (i * 40 + 1)::int, 40))) end as hit from n)
select item_id, case when there then 'OK' when hit / n >= 0.5 then 'PARTIAL' else 'MISSING' end as bucket, case when there then 1.0 else round(hit / n, 3) end as rate from c""")
def containment_audit(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("scope"), "page_id", F.regexp_replace("html", "<[^>]*>", "").alias("t"))
    lines = load(spark, sf_dir, "benchmark").select("item_id", F.lit(0).alias("line_no"), F.col("text").alias("line"), (F.col("item_id") % 5).alias("scope"))
    return evaluation.containment(lines, pages, "item_id", "scope", "page_id", "t").select("item_id", "bucket", "rate")


# ---- sets, windows, checks


@query("select 'a' as side, doc_id from (select doc_id from documents except select doc_id from labels) union all select 'b' as side, doc_id from (select doc_id from labels except select doc_id from documents)")
def set_diff_two_way(spark, sf_dir):
    return evaluation.set_difference(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id"])


@query("with n as (select source, lang, count(*) as cnt, min(doc_id) as seen from documents group by all), r as (select *, row_number() over (partition by source order by cnt desc, seen) as k from n) select source, lang, cnt from r where k = 1")
def mode_first_seen(spark, sf_dir):
    return evaluation.mode_first_seen(load(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("with d as (select distinct l_orderkey, l_linenumber::bigint as a from lineitem), n as (select l_orderkey, a as \"after\", lead(a) over (partition by l_orderkey order by a) as \"before\" from d) select * from n where \"before\" > \"after\" + 1")
def gap_detection(spark, sf_dir):
    return checks.gaps(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("select l_orderkey, count(*) as n, min(l_linenumber)::bigint as lo, max(l_linenumber)::bigint as hi from lineitem group by 1 having min(l_linenumber) <> 1 or max(l_linenumber) <> count(*) or count(distinct l_linenumber) <> count(*)")
def seq_continuity_violations(spark, sf_dir):
    return checks.continuity(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicates(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("with a as (select conv_id, turn, role from conversations), b as (select conv_id, turn, case when turn % 4 = 3 then 'x' else role end as role from conversations) select coalesce(a.conv_id, b.conv_id) as conv_id, min(coalesce(a.turn, b.turn)) as turn from a full join b on a.conv_id = b.conv_id and a.turn = b.turn where a.role is distinct from b.role group by 1")
def positional_first_mismatch(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return checks.first_mismatch(c, c.withColumn("role", F.when(F.col("turn") % 4 == 3, "x").otherwise(F.col("role"))), "conv_id", "turn", "role").withColumnRenamed("pos", "turn")


@query(f"with {LINES}, h as (select doc_id, line_no, lead(line_no) over (partition by doc_id order by line_no) as nxt from k where kind = 'head') select doc_id, line_no::bigint as start, nxt::bigint as stop from h")
def next_marker_slice(spark, sf_dir):
    heads = doc_lines(spark, sf_dir).where("kind = 'head'").select("doc_id", F.col("line_no").cast("long").alias("start"))
    return heads.withColumn("stop", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")))


# ---- glossary


@query(more_sql.COLON)
def glossary_extract(spark, sf_dir):
    return glossary.colon_terms(load(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit(":")).alias("text")), "doc_id", "text").select("doc_id", "term", F.sha2("definition", 256).alias("digest"))


TERMS = "te as (select distinct substr(regexp_replace(text, '\\s+', '', 'g'), 1, (3 + item_id % 20)::int) as term from benchmark)"


def some_terms(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.expr("substring(regexp_replace(text, '\\\\s+', ''), 1, cast(3 + item_id % 20 as int))").alias("term")).distinct()


@query(f"with {TERMS}, h as (select item_id, term from benchmark join te on contains(regexp_replace(text, '\\s+', '', 'g'), term) and length(term) >= 2) select item_id, term from h where not exists (select 1 from h g where g.item_id = h.item_id and length(g.term) > length(h.term) and contains(g.term, h.term))")
def glossary_longest_match(spark, sf_dir):
    return glossary.longest_matches(load(spark, sf_dir, "benchmark"), "item_id", "text", some_terms(spark, sf_dir))


@query("with e as (select label, vec_id, vec_id % 3 = 0 as d, vec_id % 7 = 0 as c from embeddings), r as (select *, row_number() over (partition by label order by d desc, c desc, vec_id) as k from e) select label, vec_id from r where k = 1")
def representative_pick(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("ord"))
    return glossary.representative(e, "label", F.col("ord") % 7 == 0, F.col("ord") % 3 == 0).select("label", F.col("ord").alias("vec_id"))


@query(more_sql.LEVELS)
def term_match_levels(spark, sf_dir):
    terms = load(spark, sf_dir, "benchmark").select(F.expr("concat_ws(' ', slice(split(text, ' '), 1, 3))").alias("term"), F.col("item_id").alias("ord"), F.concat(F.lit("DOC::"), F.col("item_id").cast("string")).alias("source_id"))
    asked = terms.select(F.expr("element_at(split(term, ' '), cast(1 + ord % 3 as int))").alias("raw")).distinct()
    return glossary.term_levels(asked, terms)


@query(more_sql.injected(fused_sql().replace("rank <= 10", "rank <= 3")))
def definition_injection(spark, sf_dir):
    cut = F.expr("substring(regexp_replace(text, '\\\\s+', ''), 1, cast(3 + item_id % 20 as int))")
    terms = load(spark, sf_dir, "benchmark").select(cut.alias("term"), "item_id").groupBy("term").agg(F.min("item_id").alias("ord"))
    items = load(spark, sf_dir, "benchmark")
    picked = glossary.longest_matches(items, "item_id", "text", terms)
    texts = fused(spark, sf_dir, 3).join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return glossary.result_terms(texts, "item_id", "text", terms, picked)


# ---- sequential folds


@query(more_sql.LABELS)
def numbering_expand(spark, sf_dir):
    from vellum.operators.numbering import numbering_expand

    rows = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("pos"), F.lit("l").alias("list_id"), F.expr("cast(turn % 3 as int)").alias("level"), F.expr("if(turn % 3 = 1, 'lowerLetter', 'decimal')").alias("format"), F.expr("case turn % 3 when 0 then '%1.' when 1 then '%1.%2' else '%1.%2.%3' end").alias("template"), F.lit(None).cast("double").alias("start"))
    return numbering_expand(rows, "conv_id").select("conv_id", "pos", "label")


@query("with c as (select conv_id, turn::int as pos, turn % 4 as n from conversations), s as (select *, 1 + count(case when n <= p then 1 end) over (partition by conv_id order by pos rows unbounded preceding) as scope from (select *, lag(n) over (partition by conv_id order by pos) as p from c)) select conv_id, pos, 'IE사례' || scope || '-' || n as synthetic_id from s")
def synthetic_number_scope(spark, sf_dir):
    from vellum.operators.numbering import synthetic_number_scope

    rows = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("pos"), F.lit("IE").alias("zone"), F.expr("string(turn % 4)").alias("number"))
    return synthetic_number_scope(rows, "conv_id").select("conv_id", "pos", "synthetic_id")


# ---- sources and set operations


@query("select doc_id, lang as title, length(text)::bigint as n from documents")
def front_matter_scan(spark, sf_dir):
    from vellum.sources.markdown import front_matter

    d = load(spark, sf_dir, "documents").select("doc_id", front_matter(F.concat(F.lit('---\nsource_type: x\ntitle: "'), F.col("lang"), F.lit('"\n---\n'), F.col("text"))).alias("f"))
    return d.select("doc_id", F.col("f.meta")["title"].alias("title"), F.length("f.body").cast("long").alias("n"))


@query("select conv_id, turn, role as kind, 'true' as flag from conversations")
def annotation_scan(spark, sf_dir):
    from vellum.sources.markdown import annotations

    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", annotations(F.concat(F.lit("<!-- kind: "), F.col("role"), F.lit(" | open -->"))).alias("m"))
    return c.select("conv_id", "turn", F.col("m")["kind"].alias("kind"), F.col("m")["open"].alias("flag"))


@query("select doc_id from documents where source in ('src1', 'src2') union select doc_id from labels where toxic = 1")
def set_union(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id").union(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("select source, lang, count(*) as n, count(case when n_chars > 1000 then 1 end) as n_long, min(n_chars) as lo, max(n_chars) as hi from documents group by all")
def group_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query("select d.doc_id, d.lang, l.quality from documents d left join labels l using (doc_id) where l.quality is distinct from 1")
def roundtrip_mismatches(spark, sf_dir):
    joined = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where(~F.col("quality").eqNullSafe(F.lit(1))).select("doc_id", "lang", "quality")


from vellum.plans import audit, conversion, service  # noqa: E402, F401 (they register themselves)
