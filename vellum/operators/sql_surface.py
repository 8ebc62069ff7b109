"""The three public operations as SQL table functions over a built index: `select * from standards_search('...', ...)`, or beside a
table of requests with `lateral`. They are SQL themselves, so a call is planned with the query around it, as one plan.

    select r.qid, s.* from requests r, lateral standards_search(r.query, r.vec, r.standard_no, r.source_type, r.para_type, r.top_k, false, false, false) s

A lateral search carries the arguments of its call, the vector too, beside every point that it meets, so it is for single calls and small tables. `register_answers` is for tables of
requests of any size: the view name_answers has the results of all of them by qid, of the service's own search, in which only scores stand beside points.

A request that is not valid (see vellum.operators.service) gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import gloss_norm, logical_id
from vellum.operators import search
from vellum.operators import service as S
from vellum.operators.index import SearchIndex


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


PARAGRAPH = """create or replace temporary function {name}_get_paragraph(wanted string comment 'composite id', context int default 0)
returns table (seq bigint, cid string, para_type string, standard_no string, section_path string, text string, is_context boolean)
return select n.seq, n.cid, p.para_type, p.standard_no, p.section_path, p.text, n.cid <> a.asked
from (select q.asked, t.source_file, explode(sequence(t.seq - q.width, t.seq + q.width)) as at from (select wanted as asked, context as width) q join {name}_numbers t on t.cid = q.asked
  where q.width between 0 and {most_context} and instr(q.asked, '#') = 0) a
join {name}_numbers n on n.source_file = a.source_file and n.seq = a.at join {name}_paragraphs p on p.cid = n.cid"""

SEARCH = """create or replace temporary function {name}_search(query string, query_vec array<double>, standards array<string> default null, sources array<string> default null, kind string default null,
  top_k int default 8, include_examples boolean default false, include_bc boolean default false, include_framework boolean default false)
returns table (rank bigint, cid string, score double, para_type string, standard_no string, text string)
return select h.rank, h.cid, h.score, p.para_type, p.standard_no, p.text from (
  select cid, score, row_number() over (order by best) as rank from (
    select cid, min(place) as best, max(score) as score from (
      select point, cid, score, row_number() over (order by score desc, point) as place from (
        select point, cid, round(sum(1 / ({rrf}D + r)), 9) as score from (
          select branch, point, cid, row_number() over (partition by branch order by score desc, point) as r from (
            select s.branch, s.point, s.score, pt.cid from (
              select 1 as branch, e.point, round(sum({weight} * e.idf), 9) as score from (
                select b.segment, e.{key} as point, e.tf, e.dl, a.idf from (select distinct explode(regexp_extract_all(lower(query), '{token}', 0)) as tok) q
                join {name}_terms a on a.tok = q.tok join {name}_blocks b on b.tok = q.tok lateral view explode(b.entries) x as e) e
              left anti join {name}_tombstones d on d.segment = e.segment and d.point = e.point group by e.point
              union all select 2, v.point, round(aggregate(zip_with(v.vec, query_vec, (x, y) -> x * y), 0D, (t, x) -> t + x), 9) from {name}_vectors v where query_vec is not null) s
            join {name}_points pt on pt.point = s.point
            where (coalesce(size(standards), 0) < 1 or array_contains(standards, pt.standard_no)) and (coalesce(size(sources), 0) < 1 or array_contains(sources, pt.source_type)) and (kind is null or kind = pt.para_type)
              and (coalesce(include_examples, false) or pt.para_type <=> kind or pt.para_type not in ({examples})) and (coalesce(include_bc, false) or pt.para_type <=> kind or pt.para_type not in ({bc}))
              and (coalesce(include_framework, false) or array_contains(coalesce(standards, array()), pt.standard_no) or pt.standard_no not in ({framework}))))
          where r <= {prefetch} group by point, cid)) group by cid)) h
join {name}_paragraphs p on p.cid = h.cid
where h.rank <= top_k and length(query) between 1 and {most_query} and top_k between 1 and {most_top} and (kind is null or kind in ({kinds}))
  and (sources is null or size(array_except(sources, array({source_types}))) = 0)"""

TERM = """create or replace temporary function {name}_define_term(raw string, context string default null)
returns table (place bigint, level int, term string, source_id string, standard_no string, definition string)
return select row_number() over (order by not (standard_no <=> context), ord), level, term, source_id, standard_no, definition from (
  select *, min(level) over () as first_level, first_value(norm) over (order by level, case when level > 2 then length(norm) else 0 end, ord) as picked from (
    select *, case when term = raw then 1 when norm = {norm} then 2 when length({norm}) >= 2 and head and array_contains(words, {norm}) then 3 when length({norm}) >= 2 and instr(norm, {norm}) > 0 then 4 end as level from {name}_entries)
  where level is not null)
where (first_level < 3 and level = first_level) or (first_level > 2 and norm = picked)"""


def _views(name: str, views: dict[str, DataFrame]) -> None:
    for view, rows in views.items():
        rows.createOrReplaceTempView(f"{name}_{view}")


def register_paragraphs(spark: SparkSession, points: DataFrame, name: str = "standards") -> None:
    """Makes name_get_paragraph. points: as of vellum.operators.service."""
    numbers = points.select(logical_id(F.col("composite_id")).alias("cid"), "source_file", "seq").distinct()
    _views(name, {"numbers": numbers, "paragraphs": S.reassembled_points(points)})
    spark.sql(PARAGRAPH.format(name=name, most_context=S.MAX_CONTEXT))


def register_terms(spark: SparkSession, entries: DataFrame, name: str = "standards") -> None:
    """Makes name_define_term. entries: as of service.define_terms."""
    head = entries.withColumn("norm", gloss_norm(F.col("term"))).groupBy("norm").agg(F.min("ord").alias("_first"))
    whole = entries.withColumn("norm", gloss_norm(F.col("term"))).join(head, "norm").withColumn("head", F.col("ord") == F.col("_first"))
    _views(name, {"entries": whole.select("term", "ord", "definition", "source_id", "standard_no", "norm", "head", F.transform(F.split("term", r"\s+"), gloss_norm).alias("words"))})
    spark.sql(TERM.format(name=name, norm=r"regexp_replace(replace(raw, '*', ''), '(?U)\\s+', '')"))


def register_search(spark: SparkSession, index: SearchIndex, vectors: DataFrame, name: str = "standards") -> None:
    """Makes name_search, beside name_paragraphs. vectors: the index's key, vec."""
    m = index.manifest
    dead = index.tombstones
    points = index.points.withColumn("cid", logical_id(F.col("composite_id"))).withColumnRenamed(index.key, "point")
    _views(name, {
        "points": points.select("point", "cid", "standard_no", "source_type", "para_type"), "terms": index.terms.select("tok", "idf"), "blocks": index.every("blocks").select("segment", "tok", "entries"),
        "vectors": vectors.select(F.col(index.key).alias("point"), F.col("vec").cast("array<double>").alias("vec")),
        "tombstones": spark.createDataFrame([], "segment int, point long") if dead is None else dead.withColumnRenamed(index.key, "point"),
    })
    k1, b = m["k1"], m["b"]
    spark.sql(SEARCH.format(
        name=name, key=index.key, most_query=S.MAX_QUERY, most_top=S.MAX_TOP, rrf=search.RRF_K, prefetch=search.PREFETCH, token=search.TOKEN.replace("\\", "\\\\"),
        weight=f"(e.tf * {k1 + 1}D / (e.tf + {k1}D * (1 - {b}D + {b}D * e.dl / {m['avgdl']!r}D)))", examples=listed(S.EXAMPLE_TYPES), bc=listed(S.BC_TYPES), framework=listed(S.FRAMEWORK_NOS), kinds=listed(S.PARA_TYPES),
        source_types=listed(S.SOURCE_TYPES.values()),
    ))


def register(spark: SparkSession, index: SearchIndex, vectors: DataFrame, entries: DataFrame, name: str = "standards") -> None:
    """Makes name_search, name_get_paragraph and name_define_term. vectors: the index's key, vec; entries: as of service.define_terms."""
    register_paragraphs(spark, index.points, name)
    register_terms(spark, entries, name)
    register_search(spark, index, vectors, name)


def register_answers(index: SearchIndex, requests: DataFrame, query_vectors: DataFrame, vectors: DataFrame, folder: str | None = None, name: str = "standards") -> None:
    """Makes name_answers: qid, rank, cid, score, para_type, standard_no, text of a whole table of requests. Arguments as of service.search_points."""
    results = S.search_points(index, requests, query_vectors, vectors, folder)[0]
    _views(name, {"answers": results.select("qid", "rank", "cid", "score", "para_type", "standard_no", "text")})
