"""Queries for pairs parsed once, dictionaries of words, place-name features, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import addresses, features, lexicon, profile, statistics
from tessera.operators import evaluate as E
from tessera.plans.base import ADDRESS, EL, PAIRS, TAGS, elements, name_pairs, phonetic, postcode, query, table, tokens
from tessera.plans.matching import _CODES, _SCORES, _TOK, _metrics, scores
from tessera.plans.texts import _PARSED, _RATE
from tessera.sources import tables

_PARTS = ("road", "house_number", "city", "postcode")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element's address with that of the next id."""
    rows = elements(spark, sf_dir).select("id", "street", "city", F.expr(ADDRESS).alias("address"))
    other = rows.select((F.col("id") - 1).alias("id"), F.col("street").alias("street_2"), F.col("city").alias("city_2"), F.col("address").alias("address_2"))
    return rows.join(other, "id")


@query(f"with {_PARSED} select x.id, " + ", ".join(f"x.{c} as {c}_1, y.{c} as {c}_2" for c in _PARTS) + " from pa x join pa y on y.id = x.id + 1")
def parse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = addresses.parse_pairs(_neighbours(spark, sf_dir), "address", "address_2")
    return parsed.select("id", *(F.col(f"parsed_{k}.{c}").alias(f"{c}_{k}") for c in _PARTS for k in (1, 2)))


_SIDES = "sd as (select 1 as side, x.* from pa x semi join pa y on y.id = x.id + 1 union all select 2, y.* from pa y semi join pa x on y.id = x.id + 1)"


@query(f"with {_PARSED}, {_SIDES} select side, " + ", ".join(f"{_RATE.format(f'{c} <> ' + chr(39) * 2)} as {c}_rate" for c in _PARTS) + f", {_RATE.format('road <> %s and city <> %s' % (chr(39) * 2, chr(39) * 2))} as complete_rate from sd group by side")
def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.pair_coverage(addresses.parse_pairs(_neighbours(spark, sf_dir), "address", "address_2"))


def _entities(c: str) -> str:
    word = r"\p{Lu}[\p{L}''-]+"
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '({word}(?: (?:d[aeo]s? )?{word})*)'), lambda e: lower(e)))"


def _jaccard(a: str, b: str) -> str:
    return f"round(case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else cast(len(list_intersect({a}, {b})) as double) / len(list_distinct(list_concat({a}, {b}))) end, 6)"


_PLACES = f"""en as (select id, {_entities(ADDRESS)} as a, {_entities('street')} as r, {_entities('city')} as c from el),
ep as (select x.id, x.a as a1, y.a as a2, x.r as r1, y.r as r2, x.c as c1, y.c as c2 from en x join en y on y.id = x.id + 1)"""


@query(f"""with {EL}, {_PLACES} select id, {_jaccard('a1', 'a2')} as ner_loc_similarity, {_jaccard('r1', 'r2')} as ner_road_loc_similarity, {_jaccard('c1', 'c2')} as ner_city_loc_similarity,
len(a1) as ner_address1_loc_count, len(a2) as ner_address2_loc_count, abs(len(a1) - len(a2)) as ner_entity_count_diff, len(a1) > 0 or len(a2) > 0 as ner_has_location_entities, len(a1) > 0 and len(a2) > 0 as ner_both_have_locations,
len(list_intersect(a1, a2)) as ner_shared_entities, len(list_distinct(list_concat(a1, a2))) as ner_total_unique_entities from ep""")
def location_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: features.entities(F.col(c))
    found = features.location_features((of("address"), of("address_2")), (of("street"), of("street_2")), (of("city"), of("city_2")))
    rounded = {n: F.round(c, 6) if n.endswith("similarity") else c.cast("long") if "count" in n or n.endswith("entities") and "has" not in n else c for n, c in found.items()}
    return _neighbours(spark, sf_dir).select("id", *(c.alias(n) for n, c in rounded.items()))


_LABELS = "lf as (select levenshtein, jaccard, label from sc)"


@query(f"with {PAIRS}, {_TOK}, {_SCORES}, {_LABELS} select label, count(*) as n, round(avg(levenshtein), 6) as mean_levenshtein, round(avg(jaccard), 6) as mean_jaccard from lf group by label")
def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.class_means(scores(spark, sf_dir), "label", ["levenshtein", "jaccard"])
    return rows.select("label", "n", *(F.round(c, 6).alias(c) for c in ("mean_levenshtein", "mean_jaccard")))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("a", T.phonetic_words(F.col("a")).alias("words")).distinct()


@query(f"with {PAIRS}, {_CODES} select w as word, code from cd")
def word_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of all words of names, by soundex."""
    return lexicon.phonetic_codes(_words(spark, sf_dir), "words", "soundex")


@query(f"with {PAIRS}, {_CODES} select distinct a, array_to_string(list_sort(codes), ' ') as codes from pr join tc on tc.t = a")
def word_code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.code_sets(_words(spark, sf_dir), "a", "words", "soundex").select("a", F.array_join("codes", " ").alias("codes"))


@query()
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of all words of the documents; SQL has no such stemmer, tests have vectors."""
    return lexicon.stems(table(spark, sf_dir, "documents").select(T.tokenize(F.col("text")).alias("words")), "words")


@query("select source, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from documents group by source order by n desc, source limit 10")
def source_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "documents"), "source", 10).withColumn("percent", F.round("percent", 6))


_ATTRIBUTES = " union all ".join(f"select '{a}' as attribute" for a in profile.BUILDING_ATTRIBUTES)


@query(f"with {EL}, {TAGS}, wanted as ({_ATTRIBUTES}), bu as (select id from tg where key = 'building') select attribute, count(t.id) as n, round(count(t.id) * 100.0 / (select count(*) from bu), 6) as percent from wanted left join (select * from tg semi join bu using (id)) t on t.key = attribute group by attribute")
def building_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.building_attributes(elements(spark, sf_dir), "tags").withColumn("percent", F.round("percent", 6))


@query(f"with {EL}, {TAGS} select el.id, cast(count(key) as bigint) as n_tags from el left join tg on tg.id = el.id where el.id % 3 <> 0 group by el.id union all select id, 1 from el where id % 3 = 0")
def tags_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as a map, or where that is null from the text beside it."""
    rows = elements(spark, sf_dir).withColumn("parsed_tags", F.lit("{'name': 'from the text'}")).withColumn("tags", F.when(F.col("id") % 3 != 0, F.col("tags")))
    return rows.select("id", F.size(profile.tags_of(rows, "tags", "parsed_tags", "not_there")).cast("long").alias("n_tags"))


@query(f"with {EL}, v as (select postcode as value from el where postcode is not null and {postcode('postcode')} is null) select value, count(*) as n from v group by value")
def failed_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.failures(elements(spark, sf_dir), "postcode", T.normalize_postcode(F.col("postcode")))


@query("select l_orderkey, l_linenumber, count(l_quantity) over w as runs, round(avg(l_quantity) over w, 6) as running_mean from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and current row)")
def running_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.running_mean(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", "runs", F.round("running_mean", 6).alias("running_mean"))


@query("""with s as (select l_shipmode as index_type, avg(b) / avg(n) as speedup from (select l_suppkey % 4 as l_shipmode, l_suppkey, l_quantity as b, l_quantity / 2 + 1 as n from lineitem) group by l_shipmode, l_suppkey),
b as (select s_suppkey % 4 as index_type, avg(s_acctbal) as build_time from supplier group by 1)
select index_type, round(build_time, 6) as build_time, round(avg(speedup), 6) as mean_speedup, count(*) as tests from b join s using (index_type) group by index_type, build_time""")
def build_and_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What indexes cost and gain, as it were."""
    tests = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("index_type"), "l_suppkey").agg((F.avg("l_quantity") / F.avg(F.col("l_quantity") / 2 + 1)).alias("speedup"))
    builds = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 4).alias("index_type")).agg(F.avg("s_acctbal").alias("build_time"))
    out = statistics.built_speedups(builds, tests, "index_type")
    return out.select("index_type", F.round("build_time", 6).alias("build_time"), F.round("mean_speedup", 6).alias("mean_speedup"), "tests")


_T = tokens(ADDRESS)


@query(f"with {EL}, t as (select id, {ADDRESS} as original, {_T} as t from el) select id, original, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, list_max(list_transform(t, lambda w: length(w))) as longest from t")
def token_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.token_analysis(F.expr(ADDRESS), T.tokenize(F.expr(ADDRESS)))
    rows = elements(spark, sf_dir).select("id", found.alias("a"))
    return rows.select("id", "a.original", *(F.col(f"a.{c}").cast("long").alias(c) for c in ("n_tokens", "n_distinct", "longest")))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'widget')")
def named_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.named_like(table(spark, sf_dir, "part"), "p_name", "Widget").select("p_partkey", "p_name")


_TRIPLES = "wt as (select a / 10.0e0 as u, b / 10.0e0 as v, (10 - a - b) / 10.0e0 as w from (values (2), (4), (6)) x(a), (values (2), (4), (6)) y(b) where 10 - a - b > 1)"


@query(f"with {PAIRS}, {_TOK}, {_SCORES}, {_TRIPLES}, ws as (select u, v, w, label, round(levenshtein * u + jaccard * v + (case when length(a) = length(b) then 1 else 0 end) * w, 9) as score from sc, wt), m as (select u as weight_levenshtein, v as weight_jaccard, w as weight_same_length, {_metrics('score', 'label', '0.45')} from ws group by u, v, w) select weight_levenshtein, weight_jaccard, weight_same_length, precision, recall, f1_score from m")
def weight_grid_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("same_length", (F.length("a") == F.length("b")).cast("double"))
    return E.weight_grid(rows, ["levenshtein", "jaccard", "same_length"], 0.45 - 5e-10)


@query(f"with {EL} select case when street is null then 'no street' when city is null then 'no city' else 'no postcode' end as reason, count(*) as n from el where street is null or city is null or postcode is null group by 1 order by n desc, reason limit 5")
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = elements(spark, sf_dir).where("street is null or city is null or postcode is null")
    reason = F.when(F.col("street").isNull(), "no street").when(F.col("city").isNull(), "no city").otherwise("no postcode")
    return tables.error_report(bad.withColumn("reason", reason), "reason")
