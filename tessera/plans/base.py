"""Address data derived from the driver tables, in Spark and in SQL, and SQL for the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Elements: customers as tagged elements. Every expression reads alike in both dialects.
STREET = "case when c_custkey % 2 = 0 then concat(case c_custkey % 12 when 0 then 'R. ' when 2 then 'Rua ' when 4 then 'Av. da ' when 6 then 'St ' when 8 then 'TRAVESSA ' else '' end, c_mktsegment, ' de ', c_name) end"
NUMBER = "case when c_custkey % 5 <> 0 then concat(cast(c_custkey % 200 as varchar(20)), case c_custkey % 7 when 1 then 'A' when 2 then '-12' when 3 then '/3' when 4 then ', 8' when 5 then ' andar' else '' end) end"
POSTCODE = "case when c_custkey % 3 <> 1 then case c_custkey % 5 when 0 then lpad(cast(c_custkey * 3719 % 10000000 as varchar(20)), 7, '0') when 1 then concat(lpad(cast(c_custkey * 37 % 10000 as varchar(20)), 4, '0'), '-', lpad(cast(c_custkey % 1000 as varchar(20)), 3, '0')) when 2 then lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0') when 3 then concat('PT-', lpad(cast(c_custkey * 11 % 10000 as varchar(20)), 4, '0'), ' 001') else 'none' end end"
CITY = "case when c_custkey % 4 <> 3 then concat(case c_custkey % 3 when 0 then 'São ' when 1 then 'VILA ' else 'Póvoa-' end, cast(c_nationkey as varchar(20))) end"
COLUMNS = {
    "id": "c_custkey", "type": "case when c_custkey % 4 = 0 then 'way' else 'node' end", "street": STREET, "number": NUMBER, "postcode": POSTCODE, "city": CITY,
    "country": "case when c_custkey % 11 = 0 then 'PT' end", "building": "case when c_custkey % 3 = 0 then lower(c_mktsegment) end",
    "lon": "cast(-9.5 as double) + cast(c_custkey % 331 as double) / 100", "lat": "cast(37 as double) + cast(c_custkey * 7 % 487 as double) / 100",
}
EL = "el as (select " + ", ".join(f"{e} as {n}" for n, e in COLUMNS.items()) + " from customer)"
KEYS = {"building": "building", "street": "addr:street", "number": "addr:housenumber", "city": "addr:city", "postcode": "addr:postcode", "country": "addr:country"}
TAGS = "tg as (" + " union all ".join(f"select id, '{k}' as key, {c} as value from el where {c} is not null" for c, k in KEYS.items()) + ")"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(*(F.expr(e.replace("varchar(20)", "string")).alias(n) for n, e in COLUMNS.items()))
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for c, k in KEYS.items())), lambda e: e["value"].isNotNull())
    return rows.withColumn("tags", F.map_from_entries(entries))


ADDRESS = "concat_ws(', ', street, number, postcode, city)"
#: Pairs of part names of one brand.
PAIRS = """pn as (select distinct p_brand as brand, lower(p_name) as name from part),
pr as (select a.brand, a.name as a, b.name as b from pn a join pn b on a.brand = b.brand and a.name <> b.name)"""


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked by brand: each of a brand's distinct names with its other ones."""
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.lower("p_name").alias("a")).distinct()
    return names.join(names.withColumnRenamed("a", "b"), "brand").where("a <> b")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def pre(x: str) -> str:
    """preprocess()"""
    out = f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[!-,/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"
    for broken, whole in T.BROKEN:
        out = f"replace({out}, '{broken}', '{whole}')"
    return f"coalesce({out}, '')"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def chars(x: str) -> str:
    """normalize_characters()"""
    return f"coalesce(trim(regexp_replace(strip_accents(lower({x})), '\\s+', ' ', 'g')), '')"


def full(w: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in T.PREFIX_OF.items())
    return f"case regexp_replace({w}, '\\.+$', '') {cases} else {w} end"


def street(x: str) -> str:
    ws = words(pre(x))
    rest = f"list_filter(list_slice({ws}, 2, 100000), lambda w: w not in ({quoted(T.STOP_WORDS)}))"
    return f"case when len({ws}) > 0 then array_to_string(list_concat([{full(f'({ws})[1]')}], {rest}), ' ') else '' end"


def query_text(x: str) -> str:
    return f"array_to_string(list_filter(list_transform({words(pre(x))}, lambda v: {full('v')}), lambda w: w not in ({quoted(T.STOP_WORDS)})), ' ')"


def postcode(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"case when length({d}) = 7 then substr({d}, 1, 4) || '-' || substr({d}, 5, 3) end"


def tokens(x: str) -> str:
    """tokenize()"""
    plain = f"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in T.ABBREVIATIONS.items())
    return f"list_filter(list_transform({words(plain)}, lambda v: case v {cases} else v end), lambda w: length(w) >= 2 and w not in ({quoted(T.TOKEN_STOP_WORDS)}))"


def jaccard(a: str, b: str) -> str:
    """Of two lists."""
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else cast(len(list_intersect({a}, {b})) as double) / len(list_distinct(list_concat({a}, {b}))) end"


def levenshtein(a: str, b: str) -> str:
    x, y = chars(a), chars(b)
    return f"case when {x} = '' and {y} = '' then 1.0 when {x} = '' or {y} = '' then 0.0 else 1 - cast(levenshtein({x}, {y}) as double) / greatest(length({x}), length({y})) end"


def phonetic(x: str) -> str:
    out = f"strip_accents(lower(trim({x})))"
    for a, b in T.PHONETIC:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"coalesce(trim(regexp_replace(regexp_replace({out}, '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')), '')"
    return f"list_filter({words(out)}, lambda w: length(w) >= 3 and w not in ({quoted(T.PHONETIC_STOP_WORDS)}))"
