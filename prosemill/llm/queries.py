"""The registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm import embedding_dedup, language_id, license_scan, mixing, ngram_join, packing, pii, substring_dedup, token_output, topk


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_docs(spark, sf_dir), words=3, threshold=(90, 100))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_docs(spark, sf_dir)).drop("kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_docs(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir)).select("doc_id", "licenses")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_vectors(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_vectors(spark, sf_dir))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(_docs(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_docs(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_join": op1_ngram_join, "op2_substring_dedup": op2_substring_dedup, "op3_pii": op3_pii, "op4_topk": op4_topk, "op6_license_scan": op6_license_scan, "op5_token_output": op5_token_output, "op7_embedding_dedup": op7_embedding_dedup, "op8_packing": op8_packing, "op9_language_id": op9_language_id, "op10_mixing": op10_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": TOPK_SQL, "op6_license_scan": LICENSE_SQL, "op7_embedding_dedup": EMBEDDING_SQL, "op10_mixing": MIXING_SQL}


MIXING_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-1:' || coalesce(doc_id::varchar, '')) as k
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select source, source_size, 3 * source_size as lim,
         (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from s),
l as (
  select *,
    ((sum(source_size) over ()) - coalesce(sum(lim) over (order by lim / weight, source nulls last
        rows between unbounded preceding and 1 preceding), 0))::double
    / ((sum(weight) over ()) - coalesce(sum(weight) over (order by lim / weight, source nulls last
        rows between unbounded preceding and 1 preceding), 0))::double as level
  from w),
t as (
  select source, source_size, least(lim::double, coalesce(
      (select level from l x where x.lim::double > x.level * x.weight
       order by x.lim / x.weight, x.source nulls last limit 1) * weight, lim::double)) as target
  from l),
p as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
c as (
  select d.doc_id, d.size, p.source_size, p.target, p.whole,
         floor(p.target)::bigint - p.whole * p.source_size as rest,
         coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size
             rows between unbounded preceding and 1 preceding), 0)::bigint as base
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - base)))::bigint as taken from c
"""

#: What the generated documents hold: licences named in lines of their own. Patterns over lines, not the operator's tables.
LICENSE_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as s from documents),
n as (select doc_id, unnest(string_split(regexp_replace(s, '[.!?;:] +', chr(10), 'g'), chr(10))) as s from l),
f as (
  select doc_id, case
    when regexp_matches(s, '(?i)^\W*(released|licensed)\W+under\W+the\W+mit\W+license\W*$') then 'MIT'
    when regexp_matches(s, '(?i)^\W*licensed\W+under\W+the\W+apache\W+license\W+version\W+2\W+0\W*$') then 'Apache-2.0'
    when regexp_matches(s, '(?i)^\W*(this\W+work\W+is\W+)?licensed\W+under\W+the\W+gnu\W+general\W+public\W+license\W+version\W+3\W*$') then 'GPL-3.0'
    when regexp_matches(s, '(?i)^\W*licensed\W+under\W+cc\W+by\W+nc\W+4\W+0\W*$') then 'CC-BY-NC-4.0'
    end as license from n)
select d.doc_id, coalesce(string_agg(distinct f.license, ',' order by f.license), '') as licenses
from documents d left join f on f.doc_id = d.doc_id group by d.doc_id
"""

TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""

EMBEDDING_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from v),
e as (select a.vec_id as a, b.vec_id as b from u a join u b
      on a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r as (select vec_id as node, vec_id as root from u union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as component_id from r group by node),
k as (select a, count(*) as n from e group by a)
select x.vec_id, coalesce(k.n, 0)::bigint as n_links, coalesce(c.component_id, x.vec_id) as component_id,
       x.vec_id = coalesce(c.component_id, x.vec_id) as kept
from embeddings x left join c on c.node = x.vec_id left join k on k.a = x.vec_id
"""
