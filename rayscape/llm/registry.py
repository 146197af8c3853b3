"""The queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayscape.llm import bpe, embeddup, neardup, packing, quality, secrets, substrings, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.Archive.write(pages).read(pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embeddup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.link(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
q as (select page_id, octet_length(body) as payload_bytes, sha256(body) as payload_digest,
             min(page_id) over (partition by sha256(body)) as first from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from q
"""


#: Words of a text: what its white space leaves, with the case of A-Z as it is.
WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
FINITE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

EMBEDDUP_SQL = f"""
with recursive v as (select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings where {FINITE}),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95e0),
r as (select vec_id as node, vec_id as name from embeddings union select l.b, r.name from r join l on r.node = l.a),
c as (select node, min(name) as component_id from r group by node),
d as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join c on node = vec_id left join d using (vec_id)
"""

TOPK_SQL = f"""
with v as (select vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)) as e from embeddings where {FINITE}),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

SUBSTRINGS_SQL = f"""
with w as (select doc_id, {WORDS} as ws from documents),
p as (select doc_id, ws, unnest(generate_series(1, greatest(0, len(ws) - 34))) as i from w),
h as (select doc_id, i, md5_number(array_to_string(ws[i:i + 34], ' ')) as h from p),
t as (select h from h group by h having count(*) > 1),
g as (select doc_id, list_sort(list(i)) as starts from h semi join t using (h) group by doc_id),
q as (select doc_id, ws, unnest(generate_series(1, len(ws))) as k, unnest(ws) as word from w),
b as (select doc_id, unnest(starts) as i from g),
m as (select q.doc_id, q.k, q.word, b.i from q asof left join b on q.doc_id = b.doc_id and q.k >= b.i),
f as (select doc_id, k, word, i is not null and k <= i + 34 as gone from m),
s as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by k) filter (where not gone) as kept from f group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join s using (doc_id)
"""

NEARDUP_SQL = f"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as ws from documents),
p as (select doc_id, ws, unnest(generate_series(1, case when len(ws) = 0 then 0 else greatest(1, len(ws) - 4) end)) as i from w),
g as (select distinct doc_id, md5_number(len(ws[i:i + 4]) || ' ' || array_to_string(ws[i:i + 4], ' ')) as h from p),
n as (select doc_id, count(*) as size from g group by doc_id),
o as (select doc_id, h, size, row_number() over (partition by doc_id order by f, h) as k from g join n using (doc_id) join (select h, count(*) as f from g group by h) using (h)),
e as (select * from o where k <= size - ceil(size * 0.75) + 1),
c as (select distinct a.doc_id as a, b.doc_id as b, a.size as p, b.size as q from e a join e b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.size, b.size) >= 75 * greatest(a.size, b.size)),
i as (select a, b, any_value(p) as p, any_value(q) as q, count(*) as n from c join g x on x.doc_id = a join g y on y.doc_id = b and y.h = x.h group by a, b),
l as (select a, b from i where 100 * n >= 75 * (p + q - n)),
u as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as name from documents union select u.b, r.name from r join u on r.node = u.a and r.name < u.b),
m as (select node, min(name) as component_id from r group by node)
select doc_id, coalesce(size, 0) as n_shingles, component_id, doc_id = component_id as kept from documents join m on node = doc_id left join n using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op3_embeddup": EMBEDDUP_SQL, "op5_topk": TOPK_SQL, "op6_substrings": SUBSTRINGS_SQL, "op8_neardup": NEARDUP_SQL}
