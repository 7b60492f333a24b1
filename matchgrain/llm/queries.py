"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrain.llm import byte_bpe, cross_polytope, decontamination, delta_lloyd, distance_keys, license_scan, line_dedup, near_dedup, packing, pii, repeats, toxicity, url_filter
from matchgrain.llm.staging import staged

VOCABULARY = "byte_bpe_50k.json"
#: Host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels whose telling words agree; all that a template of the label is met for are met_labels."""
    out = license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")
    return out.withColumnsRenamed({"labels": "met_labels", "licenses": "labels"})


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("redacted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return distance_keys.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.delta_lloyd(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = line_dedup.kept_texts(docs, staged(line_dedup.keep_bitmaps(docs), "bitmaps"))
    return texts.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = op1_url_filter, op2_toxicity, op3_suffix_dedup, op4_license_scan, op5_token_counts, op6_near_dedup, op7_nearest, op8_best_fit_packing, op9_decontamination, op10_pii, op11_hard_negatives, op12_delta_lloyd, op13_line_dedup
    return {f.__name__: f for f in ops}


#: The url up to its query and fragment, cut at the first ``://``; rules match on host labels and path prefixes.
URL_SQL = """
with parts as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), places as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from parts
), rules(rule_host, rule_path, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best as (
  select page_id, host, path, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) as hit
  from places left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by all
)
select page_id, host, path, hit.rule as rule, coalesce(hit.verdict, 'allow') as verdict from best
"""


#: All pairs of an anchor and another row; the first five of its label, then the first five of others in each window.
NEGATIVES_SQL = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as rank,
  n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on p.anchor_id = n.anchor_id and not n.same and 100 * n.score between 80 * p.positive_score and 100 * p.positive_score
qualify rank <= 5
"""

#: One round of Lloyd: all vectors to their nearest centroids, and centroids to the floor of the mean.
ROUND_SQL = """
, a{r} as materialized (
  select vec_id, v, min(struct_pack(distance := list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::bigint, cluster := c)) as n
  from kept cross join c{r} group by vec_id, v
), s{r} as (
  select c, i, sum(x) as s, count(*) as n from (select n.cluster as c, unnest(v) as x, unnest(range(64)) as i from a{r}) group by c, i
), c{next} as materialized (
  select o.c, coalesce(u.m, o.m) as m from c{r} o left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from s{r} group by c) u on o.c = u.c
)"""
LLOYD_SQL = (
    """
with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as c, v as m from kept order by sha256('1:' || vec_id) limit 16
)"""
    + "".join(ROUND_SQL.format(r=r, next=r + 1) for r in range(4))
    + """
select vec_id, n.cluster as cluster, n.distance as distance, sum(n.distance) over (partition by n.cluster)::bigint as cluster_inertia,
  sum(n.distance) over ()::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a3 join c3 on n.cluster = c
"""
)

#: Every line by its key; keys of two documents or more keep their lines in the smallest one.
LINES_SQL = """
with lines as (
  select doc_id, unnest(parts) as line, unnest(range(len(parts))) as place from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), owners as (
  select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
), judged as (
  select doc_id, line, place, owner is not null and owner <> doc_id as gone from keyed left join owners using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": URL_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_delta_lloyd": LLOYD_SQL, "op13_line_dedup": LINES_SQL}
