"""Queries for search and space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import spatial as Z
from tessera.functions.text import STOP_WORDS
from tessera.operators import search as Q
from tessera.operators import spatial as ZO
from tessera.plans.base import EL, elements, query, quoted, table
from tessera.plans.texts import normalized
from tessera.sources.scratch import stored
from tessera.operators.addresses import full_address

_AN = "list_filter(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' and w not in (" + quoted(STOP_WORDS) + "))"
_QUERIES = "q0 as (select item_id as query_id, text as query from benchmark)"
_TERMS = f"qw as materialized (select query_id, {_AN.format('query')} as w from q0), qt as (select query_id, unnest(w) as term, unnest(range(len(w))) as nth, len(w) as n from qw)"
_INDEX = f"dw as materialized (select doc_id, {_AN.format('text')} as w from documents), ix as (select doc_id, unnest(w) as term, unnest(range(len(w))) as position from dw)"
_BM25 = """tf as (select doc_id, term, count(*) as tf from ix group by 1, 2), dl as (select doc_id, count(*) as dl from ix group by 1), st as (select count(*) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from tf group by 1), ut as (select distinct query_id, term from qt),
bm as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from ut join tf using (term) join df using (term) join dl using (doc_id), st group by 1, 2)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stored_index(table(spark, sf_dir, "documents"), "doc_id", ["text"])


def _ranked(df: DataFrame, k: int) -> DataFrame:
    """By rounded scores, so that both engines agree on ties."""
    return Q.top_k(df.withColumn("score", F.round("score", 6)), "doc_id", k).select("query_id", "doc_id", "score", "rank")


_TOP10 = "rd as (select query_id, doc_id, round(score, 6) as score from {}), rk as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from rd) select query_id, doc_id, score, rank from rk where rank <= 10"


@query(f"with {_INDEX} select term, count(*) as postings, sum(tf) as occurrences, max(tf) as most from (select doc_id, term, count(*) as tf from ix group by 1, 2) group by term")
def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.postings(table(spark, sf_dir, "documents"), "doc_id", ["text"]).groupBy("term").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


@query(f"with {_INDEX} select 'text' as field, count(*) as n, round(avg(dl), 6) as avgdl from (select doc_id, count(*) as dl from ix group by 1)")
def field_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Q.field_stats(docs, Q.postings(docs, "doc_id", ["text"]), "doc_id").withColumn("avgdl", F.round("avgdl", 6))


@query(f"with {_QUERIES}, {_TERMS}, {_INDEX}, {_BM25}, {_TOP10.format('bm')}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(Q.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), "doc_id", {"text": 1.0}), 10)


_PHRASE = "ph as (select query_id, doc_id from (select query_id, n, doc_id, position - nth as base, count(distinct nth) as met from qt join ix using (term) group by 1, 2, 3, 4) where met = n group by 1, 2)"


@query(f"with {_QUERIES}, {_TERMS}, {_INDEX}, {_PHRASE} select query_id, doc_id from ph")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.phrase_hits(_queries(spark, sf_dir), _index(spark, sf_dir), "doc_id", ["text"]).select("query_id", "doc_id")


_FUZZY = "vo as (select distinct term as variant from ix), ut as (select distinct query_id, term from qt), pv as (select distinct term, variant from (select distinct term from ut) u join vo on substr(term, 1, 2) = substr(variant, 1, 2) and abs(length(term) - length(variant)) <= 2), ev as (select term, variant, levenshtein(replace(term, 'ß', '~'), replace(variant, 'ß', '~')) as edits from pv), fz as (select query_id, term, variant, edits from ut join ev using (term) where edits <= case when length(term) < 3 then 0 when length(term) <= 5 then 1 else 2 end)"


@query(f"with {_QUERIES}, {_TERMS}, {_INDEX}, {_FUZZY} select query_id, term, variant, edits from fz")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.fuzzy_terms(_queries(spark, sf_dir), _index(spark, sf_dir)).withColumn("edits", F.col("edits").cast("long"))


@query(f"with {_QUERIES}, {_TERMS}, {_INDEX}, u as (select distinct query_id, term from qt), n as (select query_id, count(*) as n from u group by 1) select query_id, doc_id from (select query_id, doc_id, count(distinct term) as met from u join ix using (term) group by 1, 2) join n using (query_id) where met = n")
def cross_fields_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cross_fields_hits(_queries(spark, sf_dir), _index(spark, sf_dir), "doc_id", ["text"])


@query(f"with {_QUERIES}, {_TERMS}, {_INDEX}, {_BM25}, {_PHRASE}, sh as (select query_id, doc_id, sum(score) as score from (select query_id, doc_id, 5 * score as score from bm semi join ph using (query_id, doc_id) union all select query_id, doc_id, score from bm) group by 1, 2), {_TOP10.format('sh')}")
def bool_should_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = _queries(spark, sf_dir), _index(spark, sf_dir)
    phrases = stored(Q.phrase_clause(queries, index, "doc_id", {"text": 1.0}, 5.0))
    words = Q.best_field(Q.bm25(queries, index, "doc_id", {"text": 1.0}), "doc_id")
    # What holds no phrase scores by words alone, so only the ten best of it can be among the ten best of all.
    rest = Q.top_k(words.join(phrases, ["query_id", "doc_id"], "left_anti").withColumn("score", F.round("score", 6)), "doc_id", 10)
    held = Q.should([phrases, phrases.withColumn("score", F.col("score") / 5.0)], "doc_id")
    return _ranked(held.unionByName(rest.select("query_id", "doc_id", "score")), 10)


@query("select doc_id, lang from documents where (contains(lower(text), 'the') or contains(lower(lang), 'the')) and (contains(lower(text), 'or') or contains(lower(lang), 'or')) order by doc_id limit 50")
def naive_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.naive(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang"], "The, or", 50).select("doc_id", "lang")


@query("select p_partkey, round(0.7 * p_size + 0.3 * coalesce(nullif(p_size % 4 / 4.0, 0), 0.5), 6) as confidence, case when round(0.7 * p_size + 0.3 * coalesce(nullif(p_size % 4 / 4.0, 0), 0.5), 6) >= 50 then 'high' when round(0.7 * p_size + 0.3 * coalesce(nullif(p_size % 4 / 4.0, 0), 0.5), 6) >= 20 then 'medium' else 'low' end as band from part")
def lookup_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.round(Q.confidence(F.col("p_size"), (F.col("p_size") % 4) / 4), 6)
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("confidence"), Q.band(c).alias("band"))


@query()
def text_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = _queries(spark, sf_dir), _index(spark, sf_dir)
    hits = Q.phrase_prefix_hits(queries, index, "doc_id", ["text"]).withColumn("score", F.lit(1.0))
    fuzzy = Q.fuzzy_clause(queries, index, "doc_id", {"text": 1.0}, 1.0, prefix=1)
    return Q.top_k(Q.should([hits, fuzzy], "doc_id"), "doc_id", 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def two_phase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each nation, against all addresses."""
    rows = full_address(normalized(spark, sf_dir)).select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("street_clean", "city_clean", "full_address", "postcode_clean")), "improved_completeness")
    index = Q.stored_index(rows, "id", ["street_clean", "city_clean", "full_address", "postcode_clean"])
    queries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("rua building vila "), F.col("n_nationkey").cast("string")).alias("query"))
    return Q.two_phase(queries, rows, index, "id", "street_clean", "city_clean", "full_address", "postcode_clean").select("query_id", "id", "rank", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"2 * {Z.RADIUS} * asin(sqrt(least(1.0, power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"


_LIS, _OPO = (tuple(map(str, p)) for p in (Z.LISBON, Z.PORTO))


@query(f"with {EL} select count(*) filter (where {_hav('lon', 'lat', *_LIS)} <= 20000) as near_lisbon, count(*) filter (where {_hav('lon', 'lat', *_OPO)} <= 50000) as near_porto from el")
def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    return elements(spark, sf_dir).agg(F.count_if(Z.within_radius(lon, lat, Z.LISBON, 20000)).alias("near_lisbon"), F.count_if(Z.within_radius(lon, lat, Z.PORTO, 50000)).alias("near_porto"))


@query(f"with {EL} select " + ", ".join(f"count(*) filter (where lon > {b[0]} and lon < {b[2]} and lat > {b[1]} and lat < {b[3]}) as {n}" for n, b in Z.BOXES.items()) + " from el")
def bbox_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).agg(*(F.count_if(Z.within_box(F.col("lon"), F.col("lat"), b)).alias(n) for n, b in Z.BOXES.items()))


@query(f"with {EL} select count(*) as nearer_lisbon from el where {_hav('lon', 'lat', *_LIS)} < {_hav('lon', 'lat', *_OPO)}")
def nearer_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).where(Z.nearer(F.col("lon"), F.col("lat"), Z.LISBON, Z.PORTO)).agg(F.count("*").alias("nearer_lisbon"))


@query(f"with {EL} select id, round({_hav('lon', 'lat', *_LIS)}, 3) as metres from el")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("id", F.round(Z.haversine(F.col("lon"), F.col("lat"), *Z.LISBON), 3).alias("metres"))


@query(f"with {EL} select id, round(sqrt(power(lon - ({_LIS[0]}), 2) + power(lat - {_LIS[1]}, 2)), 9) as distance from el order by distance, id limit 10")
def knn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ZO.nearest(elements(spark, sf_dir), Z.LISBON, 10, "id").select("id", F.round("distance", 9).alias("distance"))


_SITES = "si as (select s_suppkey as site, -9.5 + s_suppkey % 33 / 10.0 as qlon, 37 + s_suppkey % 48 / 10.0 as qlat from supplier)"


@query(f"with {EL}, {_SITES}, d as (select site, id, round({_hav('qlon', 'qlat', 'lon', 'lat')}, 6) as metres from si, el), r as (select *, row_number() over (partition by site order by metres, id) as rank from d) select site, id, round(metres, 1) as metres, rank from r where rank <= 3")
def batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), (F.lit(-9.5) + (F.col("s_suppkey") % 33) / 10).alias("lon"), (F.lit(37.0) + (F.col("s_suppkey") % 48) / 10).alias("lat"))
    return ZO.batch_nearest(sites, elements(spark, sf_dir).select("id", "lon", "lat"), 3, "id", "site", 0.5).select("site", "id", F.round("metres", 1).alias("metres"), "rank")


@query(f"with {EL} select id, lon, lat, id % 7 <> 0 as has_point from el where id % 7 <> 0 union all select id, null, null, false from el where id % 7 = 0")
def wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    wkt = F.when(F.col("id") % 7 != 0, F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))).otherwise("POLYGON EMPTY")
    p = elements(spark, sf_dir).select("id", Z.parse_point(wkt).alias("p"))
    return p.select("id", "p.lon", "p.lat", F.col("p").isNotNull().alias("has_point"))


@query(f"with {EL} select id, round(lon + 0.5, 6) as lon, round(lat + 1, 6) as lat from el")
def way_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a rectangle 1 wide and 2 high at each element."""
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    c = Z.centroid(F.array(corner(0, 0), corner(1, 0), corner(1, 2), corner(0, 2)))
    return elements(spark, sf_dir).select("id", F.round(c["lon"], 6).alias("lon"), F.round(c["lat"], 6).alias("lat"))


@query(f"with {EL} select id, cast(floor(lon / 0.5) as bigint)::varchar || ':' || cast(floor(lat / 0.5) as bigint)::varchar as cell, lat between -90 and 90 and lon between -180 and 180 as valid from (select id, lon, lat from el)")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    return elements(spark, sf_dir).select("id", Z.cell(lon, lat, 0.5).alias("cell"), Z.valid(lon, lat).alias("valid"))


_Z = "list_sum(list_transform(range(16), lambda k: (((cast(floor((lon + 180.0) / 360.0 * 65535) as bigint) >> k) & 1) << (2 * k)) | (((cast(floor((lat + 90.0) / 180.0 * 65535) as bigint) >> k) & 1) << (2 * k + 1))))"


@query(f"with {EL}, z as (select cast({_Z} as bigint) as z from el) select row_number() over (order by z) as rank, z from z")
def z_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places' values in the order that the rows have; a partition's rows are numbered by themselves."""
    rows = ZO.z_order(elements(spark, sf_dir).select("lon", "lat")).select(ZO.z_value(F.col("lon"), F.col("lat")).alias("z"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    rows = stored(rows)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_i"))
    return rows.join(sizes.select("_p", "_before"), "_p").select(rank.alias("rank"), "z")
