"""The corpus operators as queries over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, embeddings, html, lines, ngrams, packing, pii, quality, suffixes, warc
from tessera.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.deduplicate(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_pii, op3_lines, op4_suffixes, op5_warc, op6_embeddings, op7_quality, op8_packing, op9_ngrams, op10_html, pipeline)
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
with d as (select doc_id, regexp_extract_all(LOWER(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(LOWER(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
s as (select item, w, least(13, len(w)) as size from b where len(w) > 0),
win as (select distinct item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as g
        from (select item, w, size, unnest(range(1, len(w) - size + 2)) as i from s)),
sizes as (select distinct size from win),
pos as (select doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') as g
        from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hits as (select doc_id, size, i, item from pos join win using (size, g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id
"""

OP5 = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, sha1(html) as hex, min(page_id) over (partition by html) as first from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((cast('0x' || substr(hex, cast(5 * (i // 4) + 1 as integer), 5) as integer) >> cast(5 * (3 - i % 4) as integer)) & 31) as integer), 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from h
"""

OP6 = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
u as (select vec_id, label, x, sqrt(list_inner_product(x, x)) as size from v),
e as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id where list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.93),
r(a, c) as (select vec_id, vec_id from embeddings union select e.b, r.c from r join e on r.a = e.a),
c as (select a, min(c) as component_id from r group by a),
n as (select a, count(*) as n_links from e group by a)
select c.a as vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, c.a = component_id as kept from c left join n on n.a = c.a
"""

OP9 = r"""
with recursive d as (select doc_id, regexp_extract_all(LOWER(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 90 * (na.n + nb.n - common)),
r(a, c) as (select doc_id, doc_id from d union select e.b, r.c from r join e on r.a = e.a),
c as (select a, min(c) as component_id from r group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id from d join c on c.a = d.doc_id left join n on n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    import re

    low = lambda sql: re.sub(r"LOWER\(((?:[^()]|\([^()]*\))*)\)", lambda m: _LOWER.format(m.group(1)), sql)
    return {"op1_decontamination": low(OP1), "op5_warc": OP5, "op6_embeddings": OP6, "op9_ngrams": low(OP9)}
