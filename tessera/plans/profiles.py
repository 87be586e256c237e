"""Queries for profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_postcode
from tessera.operators import profile as P
from tessera.plans.base import EL, TAGS, elements, postcode, query, table
from tessera.plans.texts import _NORMALIZED, normalized

_PERCENT = "cast({} as double) * 100.0 / {}"


@query("select event_type, count(*) as n, count(*) * 100.0 / (select count(*) from events) as percent from events group by event_type")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(f"with {EL}, {TAGS} select key, count(*) as n, count(*) * 100.0 / (select count(*) from el) as percent from tg group by key order by n desc, key limit 30")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_frequency(elements(spark, sf_dir), "tags")


@query(f"with {EL}, {TAGS} select key, count(*) as n, count(*) * 100.0 / (select count(distinct id) from tg where starts_with(key, 'addr:')) as percent from tg where starts_with(key, 'addr:') group by key order by n desc, key limit 15")
def address_tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_frequency(elements(spark, sf_dir), "tags", 15, "addr:")


@query(f"with {EL} select building, count(*) as n, count(*) * 100.0 / (select count(*) from el where building is not null) as percent from el where building is not null group by building order by n desc, building limit 15")
def building_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).where(P.has_building(F.col("tags")))
    return P.value_counts(rows, "building", 15)


_HAS = "building is not null as has_building, coalesce(street, number, postcode, city, country) is not null as has_address"


@query(f"with {EL}, h as (select {_HAS} from el) select has_building, has_address, count(*) as n, grouping(has_building) as all_has_building, grouping(has_address) as all_has_address from h group by cube (has_building, has_address)")
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).select(P.has_building(F.col("tags")).alias("has_building"), P.has_address(F.col("tags")).alias("has_address"))
    return P.crosstab(rows, "has_building", "has_address").withColumn("all_has_building", F.col("all_has_building").cast("long")).withColumn("all_has_address", F.col("all_has_address").cast("long"))


@query(f"with {EL}, h as (select *, {_HAS} from el) select count(*) as total, count(*) filter (where has_building) as buildings, count(*) filter (where has_address) as addressed, count(*) filter (where has_building and has_address) as both from h")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = P.has_building(F.col("tags")), P.has_address(F.col("tags"))
    return P.coverage(elements(spark, sf_dir), {"buildings": b, "addressed": a, "both": a & b})


_FIELDS = ("street", "number", "postcode", "city", "country", "building")


@query(f"with {EL} " + " union all ".join(f"select '{f}' as field, count(*) filter (where coalesce({f}, '') = '') as missing, count(*) filter (where coalesce({f}, '') = '') * 100.0 / count(*) as percent from el" for f in _FIELDS))
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing(elements(spark, sf_dir), list(_FIELDS))


@query(f"with {EL}, m as (" + " union all ".join(f"select '{f}' as component, 100.0 - count(*) filter (where coalesce({f}, '') = '') * 100.0 / count(*) as percent from el" for f in _FIELDS) + ") select *, case when percent > 70 then 'good' when percent > 30 then 'poor' else 'critical' end as status from m")
def component_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.component_status(elements(spark, sf_dir), list(_FIELDS))


@query(f"with {EL} select count(*) filter (where street is not null and number is not null) as complete, count(*) filter (where (street is null) <> (number is null)) as partial from el")
def complete_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("street").isNotNull(), F.col("number").isNotNull()
    return elements(spark, sf_dir).agg(F.count_if(s & n).alias("complete"), F.count_if(s != n).alias("partial"))


_LEVEL = "case when street is null or number is null then 'incomplete' when city is null then 'basic' when postcode is null then 'standard' when country is null then 'full' else 'complete' end"


@query(f"with {EL} select type, {_LEVEL} as level, count(*) as n from el group by 1, 2")
def completeness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).groupBy("type", P.level(F.col("tags")).alias("level")).agg(F.count("*").alias("n"))


@query(f"with {EL}, c as (select concat_ws('+', case when city is not null then 'city' end, case when country is not null then 'country' end, case when number is not null then 'number' end, case when postcode is not null then 'postcode' end, case when street is not null then 'street' end) as c from el) select case when c = '' then 'none' else c end as pattern, count(*) as n from c group by 1 order by n desc, pattern limit 10")
def combination_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).groupBy(P.combination(F.col("tags")).alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(10)


@query(f"with {EL} select min(lon) as min_lon, max(lon) as max_lon, avg(lon) as avg_lon, min(lat) as min_lat, max(lat) as max_lat, avg(lat) as avg_lat, max(lon) - min(lon) as span_lon, max(lat) - min(lat) as span_lat from el")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bounds(elements(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("min_lon", "max_lon", "avg_lon", "min_lat", "max_lat", "avg_lat", "span_lon", "span_lat")))


_GRID = "e as (select min(lon) w, max(lon) x, min(lat) s, max(lat) n from el), cells as (select cast(floor((lon - w) / ((x - w) / 10)) as integer) as cell_x, cast(floor((lat - s) / ((n - s) / 10)) as integer) as cell_y, count(*) as n from el, e where lon < x and lat < e.n group by 1, 2)"


@query(f"with {EL}, {_GRID} select cell_x, cell_y, n from cells")
def grid_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grid_density(elements(spark, sf_dir))


@query(f"with {EL}, {_GRID} select count(*) as cells, avg(n) as mean, max(n) as most, min(n) as least from cells")
def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grid_summary(P.grid_density(elements(spark, sf_dir)))


def _cases(c: str, formats, other: str) -> str:
    return "case " + " ".join(f"when regexp_matches({c}, '{p.replace(chr(92) + 'd', '[0-9]')}') then '{n}'" for n, p in formats) + f" else '{other}' end"


@query(f"with {EL} select 'postcode' as field, {_cases('postcode', P.POSTCODE_FORMATS, 'invalid')} as format, count(*) as n from el where postcode is not null group by 2 union all select 'number', {_cases('number', P.NUMBER_FORMATS, 'other')}, count(*) from el where number is not null group by 2")
def format_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir)
    one = lambda c, f: rows.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("field"), f(F.col(c)).alias("format")).agg(F.count("*").alias("n"))
    return one("postcode", P.postcode_format).unionByName(one("number", P.number_format))


@query(f"with {EL}, p as (select {postcode('postcode')} as p from el) select substr(p, 1, 4) as area, case when substr(p, 1, 2) in ('10', '11', '12') then 'Lisboa' when substr(p, 1, 2) in ('40', '41', '42') then 'Porto' when substr(p, 1, 2) in ('30') then 'Coimbra' else 'other' end as region, cast(substr(p, 1, 4) as integer) between 1000 and 9999 as valid, count(*) as n from p where p is not null group by 1, 2, 3")
def postcode_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = elements(spark, sf_dir).select(normalize_postcode(F.col("postcode")).alias("p")).where("p is not null")
    return p.groupBy(F.substring("p", 1, 4).alias("area"), P.postcode_area(F.col("p")).alias("region"), P.valid_postcode(F.col("p")).alias("valid")).agg(F.count("*").alias("n"))


_SPELLED = "sp as (select street, case " + " ".join(f"when starts_with(street, '{s} ') or street = '{s}' then '{k}'" for k, v in P.SPELLINGS.items() for s in v.split()) + " end as prefix, case " + " ".join(f"when starts_with(street, '{s} ') or street = '{s}' then '{s}'" for v in P.SPELLINGS.values() for s in v.split()) + " end as spelling from el where street is not null)"


@query(f"with {EL}, {_SPELLED}, c as (select prefix, spelling, count(*) as n from sp where prefix is not null group by 1, 2), r as (select *, row_number() over (partition by prefix order by n desc, spelling desc) as k from c) select prefix, cast(sum(n) as bigint) as total, count(*) as variants, max(case when k = 1 then spelling end) as commonest, cast(sum(case when k > 1 then n else 0 end) as bigint) as otherwise from r group by prefix")
def prefix_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prefix_variants(elements(spark, sf_dir), "street")


@query(f"with {EL}, {_SPELLED} select string_split(trim(street), ' ')[1] as word, count(*) as n from sp where prefix is null group by 1 order by n desc, word limit 15")
def unmatched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unmatched_first_words(elements(spark, sf_dir), "street")


@query(f"with {EL}, c as (select c, regexp_matches(c, '[a-zA-ZÀ-ÿ]') as l, array_to_string(list_transform(string_split(lower(c), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as t from (select city as c from el where city is not null union all select street from el where street is not null)) select case when l and c = upper(c) then 'upper' when l and c = lower(c) then 'lower' when l and c = t then 'title' else 'mixed' end as class, count(*) as n from c group by 1")
def case_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir)
    both = rows.select(F.col("city").alias("c")).unionByName(rows.select(F.col("street").alias("c"))).where("c is not null")
    return both.groupBy(P.case_class(F.col("c")).alias("class")).agg(F.count("*").alias("n"))


@query("with c as (select unnest(regexp_extract_all(text, '[^a-zA-Z0-9\\s]')) as character from documents) select character, count(*) as n from c group by 1 order by n desc, character limit 20")
def special_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.special_characters(table(spark, sf_dir, "documents"), "text")


@query(f"with {EL} select count(city) as total, count(distinct city) as \"distinct\", count(*) filter (where regexp_matches(city, '[^a-zA-Z0-9\\s]')) as special, count(*) filter (where regexp_matches(city, '[À-ÖØ-öø-ÿ]')) as accented, count(*) filter (where contains(city, '-')) as hyphenated from el")
def city_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.name_traits(elements(spark, sf_dir), "city")


@query(f"with {EL}, v as (select 'city' as field, city as value from el where city is not null union all select 'country', country from el where country is not null union all select 'building', building from el where building is not null), c as (select field, value, count(*) as n from v group by 1, 2), r as (select *, row_number() over (partition by field order by n desc, value) as k from c) select field, cast(sum(n) as bigint) as used, count(*) as \"distinct\", string_agg(case when k <= 5 then value end, '|' order by k) as commonest from r group by field")
def field_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.field_usage(elements(spark, sf_dir), ["city", "country", "building"])


@query(f"with {EL} select count(*) as total, count(*) filter (where city in ('São 0', 'VILA 7')) as n, count(*) filter (where city in ('São 0', 'VILA 7')) * 100.0 / count(*) as percent from el")
def major_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.share_of(elements(spark, sf_dir), "city", ["São 0", "VILA 7"])


_ISSUE = "case when trim(coalesce(text, '')) = '' then 'empty' when regexp_matches(text, 'Ã|Â|�') then 'encoding' when regexp_matches(text, '[?*#@|{}\\[\\]<>]') then 'suspicious' else 'fine' end"


@query(f"select lang, {_ISSUE} as issue, count(*) as n from documents group by 1, 2")
def issue_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", P.issues(F.col("text")).alias("issue")).agg(F.count("*").alias("n"))


@query(f"with {EL} select substr(postcode, 1, 2) as prefix, count(distinct city) as names, count(*) as n from el where coalesce(postcode, '') <> '' and coalesce(city, '') <> '' group by 1 having count(distinct city) > 1")
def prefix_city_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prefix_conflicts(elements(spark, sf_dir), "postcode", "city")


@query(f"with {_NORMALIZED}, b as (select case when improved_completeness <= 0 then null else cast(ceil(improved_completeness * 4) as integer) end as bin from nm) select bin, count(*) as n from b where bin is not null group by bin")
def completeness_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select(P.completeness_histogram(F.col("improved_completeness")).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as frequency from orders group by 1, 2 having count(*) >= 2 order by frequency desc, o_orderstatus, o_orderpriority limit 20")
def frequent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.frequent_groups(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(f"with {EL}, c as (select postcode, {postcode('postcode')} as clean from el) select 'postcode' as field, count(*) filter (where coalesce(postcode, '') <> '') as had, count(*) filter (where coalesce(postcode, '') <> '' and coalesce(clean, '') <> '') as kept, count(*) filter (where postcode <> clean) as changed, count(*) filter (where coalesce(postcode, '') <> '' and coalesce(clean, '') <> '') * 100.0 / count(*) filter (where coalesce(postcode, '') <> '') as success_percent, count(*) filter (where postcode <> clean) * 100.0 / count(*) filter (where coalesce(postcode, '') <> '') as changed_percent from c")
def correction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).withColumn("postcode_clean", normalize_postcode(F.col("postcode")))
    return P.correction_rates(rows, ["postcode"])


_TEXT = "concat('{''name'': ''', replace(p_name, 'n', ''''''), ''', ''brand'': ''', p_brand, ''', ''size'': ''', cast(p_size as varchar(10)), '''}')"


@query("select p_partkey, replace(p_name, 'n', '''') as name, p_brand as brand, cast(p_size as varchar) as size from part")
def parse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _TEXT.replace("varchar(10)", "string").replace("''''''", r"'\'\''").replace("'{''", r"'{\'").replace("'': '''", r"\': \''").replace("''', ''", r"'\', \'").replace("'''}'", r"'\'}'")
    rows = table(spark, sf_dir, "part").withColumn("t", P.parse_tags(F.expr(text)))
    return rows.select("p_partkey", *(F.element_at("t", k).alias(k) for k in ("name", "brand", "size")))
