"""Queries for normalization, parsing and address records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.functions import text as T
from tessera.operators import addresses
from tessera.plans.base import ADDRESS, EL, elements, phonetic, postcode, pre, query, query_text, street, table, tokens, words


@query(f"select doc_id, {pre('text')} as clean from documents")
def preprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preprocess(F.col("text")).alias("clean"))


@query("""with a as (select text as t, lower(text) as low from documents), b as (select t, low, strip_accents(low) as plain from a),
c as (select *, regexp_replace(plain, '[!-,/:-@\\[-`{-~]', '', 'g') as bare from b), d as (select *, trim(regexp_replace(bare, '\\s+', ' ', 'g')) as tidy from c)
select count(*) filter (where tidy <> t) as preprocessing_fixes, count(*) filter (where low <> t) as case_fixes, count(*) filter (where bare <> plain) as punctuation_fixes,
count(*) filter (where tidy <> bare) as whitespace_fixes, cast(0 as bigint) as encoding_fixes from d""")
def correction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.counters(table(spark, sf_dir, "documents"), "text")


@query(f"with {EL} select id, {street('street')} as street_clean from el where street is not null")
def street_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).where("street is not null").select("id", T.normalize_street(F.col("street")).alias("street_clean"))


@query(f"with {EL} select id, {query_text(ADDRESS)} as query_clean from el")
def query_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("id", T.normalize_query(F.expr(ADDRESS)).alias("query_clean"))


@query(f"with {EL} select id, {postcode('postcode')} as postcode_clean from el")
def postcode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("id", T.normalize_postcode(F.col("postcode")).alias("postcode_clean"))


_BEHIND = pre("regexp_extract(number, '[0-9]+(.*)$', 1)")


@query(f"with {EL} select id, cast(regexp_extract(number, '([0-9]+)', 1) as bigint) as number_primary, nullif({_BEHIND}, '') as number_specifier from el where number is not null")
def housenumber_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize_housenumber(F.col("number"))
    return elements(spark, sf_dir).where("number is not null").select("id", n["primary"].alias("number_primary"), n["specifier"].alias("number_specifier"))


@query(f"select doc_id, array_to_string({tokens('text')}, '|') as tokens from documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), "|").alias("tokens"))


@query(f"select doc_id, array_to_string({phonetic('text')}, '|') as phonetic_tokens from documents")
def phonetic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.phonetic_words(F.col("text")), "|").alias("phonetic_tokens"))


@query("""select doc_id, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) as characters, lower(trim(text)) as plain, nullif(substr(trim(text), 1, 32766), '') as cleaned from documents""")
def simple_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_characters(c).alias("characters"), T.simple(c).alias("plain"), T.clean_text(c).alias("cleaned"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.extract(elements(spark, sf_dir).select("id", "tags", "lon", "lat"))


_NORMALIZED = f"""{EL}, cl as (select id, case when street is not null then {street('street')} end as street_clean,
case when cast(regexp_extract(number, '([0-9]+)', 1) as bigint) between 1 and 999999 then cast(regexp_extract(number, '([0-9]+)', 1) as bigint) end as housenumber_primary,
case when number is not null then nullif({_BEHIND}, '') end as housenumber_specifier, {postcode('postcode')} as postcode_clean,
case when city is not null and {pre('city')} like 'vila%' then {pre('city')} end as city_clean,
((case when street is null then 0 else 1 end) + (case when number is null then 0 else 1 end) + (case when postcode is null then 0 else 1 end) + (case when city is null then 0 else 1 end)) / 4.0 as original_completeness
from el where coalesce(street, number, postcode, city, country) is not null),
nm as (select *, ((case when coalesce(street_clean, '') = '' then 0 else 1 end) + (case when housenumber_primary is null then 0 else 1 end) + (case when postcode_clean is null then 0 else 1 end) + (case when city_clean is null then 0 else 1 end)) / 4.0 as improved_completeness from cl)"""
_SHOWN = "id, street_clean, housenumber_primary, housenumber_specifier, postcode_clean, city_clean, cast(original_completeness as double) as original_completeness, cast(improved_completeness as double) as improved_completeness"


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known cities: those that begin with vila."""
    raw = _raw(spark, sf_dir)
    known = raw.select(T.preprocess(F.col("raw_city")).alias("city")).where("city like 'vila%'").distinct()
    return addresses.normalize(raw, known)


@query(f"with {_NORMALIZED} select {_SHOWN} from nm")
def address_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).selectExpr(*_SHOWN.split(", "))


@query(f"""with {_NORMALIZED} select id, concat_ws(' ', nullif(street_clean, ''), cast(housenumber_primary as varchar), postcode_clean, city_clean) as full_address,
concat_ws(', ', case when coalesce(street_clean, '') <> '' then street_clean || coalesce(' ' || cast(housenumber_primary as varchar) || coalesce(' ' || housenumber_specifier, ''), '') end, city_clean, postcode_clean) as display_address from nm""")
def address_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.display(addresses.full_address(normalized(spark, sf_dir))).select("id", "full_address", "display_address")


@query(f"with {EL} select id, concat_ws(', ', street, number, city, postcode) as address from el where street is not null and city is not null and (case when number is null then 0 else 1 end) + (case when postcode is null then 0 else 1 end) >= 1")
def pair_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.pair_text(_raw(spark, sf_dir)).select("id", "address")


@query(f"with {_NORMALIZED} select avg(original_completeness) as mean_before, avg(improved_completeness) as mean_after, (avg(improved_completeness) - avg(original_completeness)) / avg(original_completeness) as relative_change from nm")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.avg("original_completeness"), F.avg("improved_completeness")
    return normalized(spark, sf_dir).agg(a.alias("mean_before"), b.alias("mean_after"), ((b - a) / a).alias("relative_change"))


_HOUSE = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({x}, '{p}', 1)), '')" for x in ("t", "n") for p in parsing.HOUSE_NUMBER) + ", '')"
_NO_CITY = " and ".join(f"not starts_with(lower(p), '{w}')" for w in parsing.NO_CITY)
_PARSED = f"""{EL}, t0 as (select id, {ADDRESS} as t from el), t1 as (select id, t, {pre('t')} as n from t0),
t2 as (select id, t, n, regexp_extract(t, '\\b([0-9]{{4}}-[0-9]{{3}})\\b', 1) as postcode, {_HOUSE} as house_number, list_transform(string_split(t, ','), lambda q: trim(q)) as parts from t1),
t3 as (select *, case when postcode <> '' then replace(string_split(t, ',')[1], postcode, '') else string_split(t, ',')[1] end as r0,
(list_filter(list_reverse(parts), lambda p: trim(regexp_replace(p, '[0-9]', '', 'g')) <> '' and not (postcode <> '' and contains(p, postcode)) and not (house_number <> '' and p = house_number) and {_NO_CITY}))[1] as c0 from t2),
t4 as (select *, case when house_number <> '' then replace(r0, house_number, '') else r0 end as r1, case when len(parts) >= 2 and c0 is not null then {pre("trim(regexp_replace(c0, '[0-9]', '', 'g'))")} else '' end as c1 from t3),
pa as (select id, {street('trim(r1)')} as road, house_number,
array_to_string(list_transform(regexp_extract_all(c1, '([a-z]+|[^a-z]+)'), lambda g: upper(substr(g, 1, 1)) || substr(g, 2)), '') as city, postcode, n as normalized from t4)"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("id", parsing.parse(F.expr(ADDRESS)).alias("p"))


@query(f"with {_PARSED} select id, road, house_number, city, postcode, normalized from pa")
def parse_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("id", *(f"p.{c}" for c in ("road", "house_number", "city", "postcode", "normalized")))


_RATE = "avg(case when {} then 1 else 0 end) * 100"


@query(f"with {_PARSED} select " + ", ".join(f"{_RATE.format(f'{c} <> ' + chr(39) * 2)} as {c}_rate" for c in ("road", "house_number", "city", "postcode")) + f", {_RATE.format("road <> '' and city <> ''")} as complete_rate from pa")
def extraction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).agg(*parsing.extraction_rates(F.col("p")))


@query(f"select doc_id, len({words(pre('text'))}) as n_words from documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens_of(T.preprocess(F.col("text")))).cast("long").alias("n_words"))
