"""Profiles of tagged elements and address fields. Each is one aggregation, with map-side partial sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import blank

# Components with short names, formats tried in order, prefixes by spelling, areas by code.
COMPONENTS = {"street": "addr:street", "number": "addr:housenumber", "city": "addr:city", "postcode": "addr:postcode", "country": "addr:country"}
POSTCODE_FORMATS = (("standard", r"^\d{4}-\d{3}$"), ("no_hyphen", r"^\d{7}$"), ("short", r"^\d{4}$"), ("space", r"^\d{4}\s+\d{3}$"), ("extended", r"^\d{4}-\d{4,}$"))
NUMBER_FORMATS = (("number", r"^\d+$"), ("letter", r"^\d+[A-Za-z]$"), ("range", r"^\d+-\d+$"), ("letter_range", r"^\d+[A-Za-z]-\d+[A-Za-z]$"), ("fraction", r"^\d+/\d+$"), ("list", r"^\d+(,\s*\d+)+$"), ("unit", r"[Ff]loor|[Uu]nit|[Aa]ndar"))
SPELLINGS = {
    "Rua": "Rua R. R RUA", "Avenida": "Avenida Av. Av Ave AVENIDA", "Largo": "Largo Lgo. Lgo LARGO", "Praça": "Praça Pça. Pça Praca PRAÇA", "Travessa": "Travessa Tv. Tv Trav. TRAVESSA",
    "Beco": "Beco Bc. Bc BECO", "Estrada": "Estrada Est. Est ESTRADA", "Alameda": "Alameda Al. Al ALAMEDA", "Calçada": "Calçada Calc. Calc Calcada CALÇADA", "Rotunda": "Rotunda Rot. Rot ROTUNDA",
}
BUILDING_ATTRIBUTES = ("addr:housenumber", "addr:street", "addr:city", "addr:postcode", "building:levels", "name", "amenity")
AREAS = {"Lisboa": ("10", "11", "12"), "Porto": ("40", "41", "42"), "Coimbra": ("30",)}
BINS = (0.0, 0.25, 0.5, 0.75, 1.0)


def percent(n: Column, total: Column) -> Column:
    return F.when(total > 0, n * 100.0 / total).otherwise(0.0)


def parse_tags(text: Column) -> Column:
    """The text of a map, 'key': 'value' in single quotes, as a map; the last of equal keys wins, doubled quotes are one."""
    pattern = F.lit(r"'([^']+)':\s*'((?:[^']|'')*)'")
    keys, values = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == p["k"]))
    return F.when(text.isNotNull(), F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], F.replace(p["v"], F.lit("''"), F.lit("'")))))).otherwise(F.create_map().cast("map<string,string>"))


def tags_of(df: DataFrame, *columns: str) -> Column:
    """The first of the columns that is there and not null, as a map; texts are parsed."""
    kinds = dict(df.dtypes)
    there = [parse_tags(F.col(c)) if kinds[c] == "string" else F.col(c) for c in columns if c in kinds]
    found = [F.when(F.col(c).isNotNull(), t) for c, t in zip((c for c in columns if c in kinds), there, strict=True)]
    return F.coalesce(*found, F.create_map().cast("map<string,string>"))


def address_tags(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: k.startswith("addr:") & (v != ""))


def has_building(tags: Column) -> Column:
    return F.coalesce(F.map_contains_key(tags, "building"), F.lit(False))


def has_address(tags: Column) -> Column:
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: k.startswith("addr:")), F.lit(False))


def presence(tags: Column, keys: list[str]) -> list[Column]:
    return [F.coalesce(F.map_contains_key(tags, k), F.lit(False)).alias("has_" + k.replace(":", "_")) for k in keys]


def level(tags: Column) -> Column:
    """basic: street and number; standard: and city; full: and postcode; complete: and country; else incomplete."""
    has = {n: F.coalesce(F.map_contains_key(tags, k), F.lit(False)) for n, k in COMPONENTS.items()}
    out, need = F.lit("incomplete"), F.lit(True)
    for name, parts in (("basic", ("street", "number")), ("standard", ("city",)), ("full", ("postcode",)), ("complete", ("country",))):
        need = reduce(lambda a, b: a & b, (has[p] for p in parts), need)
        out = F.when(need, name).otherwise(out)
    return out


def combination(tags: Column) -> Column:
    """Short names of the components there, sorted, joined by plus signs; none without any."""
    there = F.filter(F.array(*(F.when(F.map_contains_key(tags, k), F.lit(n)) for n, k in COMPONENTS.items())), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.array_join(F.array_sort(there), "+")).otherwise("none")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values with counts and percent of all rows; ties by value."""
    total = df.agg(F.count("*").alias("_total"))
    out = df.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(column, "n", percent(F.col("n"), F.col("_total")).alias("percent"))
    return out.orderBy(F.desc("n"), column).limit(top) if top else out


def key_frequency(df: DataFrame, tags: str, top: int = 30, prefix: str | None = None) -> DataFrame:
    """How many rows have each key (of a prefix), and percent of the rows that have any such key (or of all)."""
    keys = F.map_keys(tags)
    if prefix:
        keys = F.filter(keys, lambda k: k.startswith(prefix))
        df = df.where(F.size(keys) > 0)
    total = df.agg(F.count("*").alias("_total"))
    each = df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return each.crossJoin(F.broadcast(total)).select("key", "n", percent(F.col("n"), F.col("_total")).alias("percent")).orderBy(F.desc("n"), "key").limit(top)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts with margins; a margin's value is null and its grouping 1."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias(f"all_{a}"), F.grouping(b).alias(f"all_{b}"))


def coverage(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: null or empty values, percent."""
    flat = df.agg(F.count("*").alias("total"), *(F.count_if(blank(F.col(c).cast("string"))).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns)))
    return flat.select("total", rows.alias("r")).select("r.field", "r.missing", percent(F.col("r.missing"), F.col("total")).alias("percent"))


def component_status(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows that have each component: good over 70 %, critical up to 30 %."""
    rows = missing(df, columns).select(F.col("field").alias("component"), (100.0 - F.col("percent")).alias("percent"))
    return rows.withColumn("status", F.when(F.col("percent") > 70, "good").when(F.col("percent") > 30, "poor").otherwise("critical"))


def bounds(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    ends = [f(c).alias(f"{n}_{c}") for c in (lon, lat) for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return df.agg(*ends, (F.max(lon) - F.min(lon)).alias("span_lon"), (F.max(lat) - F.min(lat)).alias("span_lat"))


def grid_density(df: DataFrame, lon: str = "lon", lat: str = "lat", n: int = 10) -> DataFrame:
    """Points by cell of an n by n grid over the bounds; points on the upper edges fall in no cell."""
    ends = df.agg(F.min(lon).alias("_w"), F.max(lon).alias("_e"), F.min(lat).alias("_s"), F.max(lat).alias("_n"))
    rows = df.crossJoin(F.broadcast(ends)).where((F.col(lon) < F.col("_e")) & (F.col(lat) < F.col("_n")))
    at = lambda c, a, b: F.floor((F.col(c) - F.col(a)) / ((F.col(b) - F.col(a)) / n)).cast("int")
    return rows.groupBy(at(lon, "_w", "_e").alias("cell_x"), at(lat, "_s", "_n").alias("cell_y")).agg(F.count("*").alias("n"))


def grid_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("cells"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"))


def first_format(c: Column, formats: tuple[tuple[str, str], ...], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(formats):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def postcode_format(c: Column) -> Column:
    return first_format(c, POSTCODE_FORMATS, "invalid")


def number_format(c: Column) -> Column:
    return first_format(c, NUMBER_FORMATS, "other")


def postcode_area(c: Column) -> Column:
    out = F.lit("other")
    for name, codes in AREAS.items():
        out = F.when(F.substring(c, 1, 2).isin(*codes), name).otherwise(out)
    return out


def valid_postcode(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 4).try_cast("int").between(1000, 9999), F.lit(False))


def street_prefix(c: Column) -> Column:
    """(prefix, spelling) of the first spelling that the street begins with or is; null of none."""
    out = F.lit(None).cast("struct<prefix: string, spelling: string>")
    for prefix, spellings in reversed(SPELLINGS.items()):
        for s in reversed(spellings.split()):
            out = F.when(c.startswith(s + " ") | (c == s), F.struct(F.lit(prefix).alias("prefix"), F.lit(s).alias("spelling"))).otherwise(out)
    return out


def prefix_variants(df: DataFrame, street: str) -> DataFrame:
    """Per prefix: streets, spellings in use, the commonest, and streets spelt otherwise."""
    each = df.select(street_prefix(F.col(street)).alias("p")).where("p is not null").groupBy("p.prefix", "p.spelling").agg(F.count("*").alias("n"))
    return each.groupBy("prefix").agg(F.sum("n").alias("total"), F.count("*").alias("variants"), F.max(F.struct("n", "spelling")).alias("m")).select("prefix", "total", "variants", F.col("m.spelling").alias("commonest"), (F.col("total") - F.col("m.n")).alias("otherwise"))


def unmatched_first_words(df: DataFrame, street: str, top: int = 15) -> DataFrame:
    rows = df.where(street_prefix(F.col(street)).isNull() & ~blank(F.trim(street)))
    return rows.groupBy(F.get(F.split(F.trim(street), " "), 0).alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def case_class(c: Column) -> Column:
    letters = c.rlike(r"\p{L}")
    return F.when(letters & (c == F.upper(c)), "upper").when(letters & (c == F.lower(c)), "lower").when(letters & (c == F.initcap(c)), "title").otherwise("mixed")


def special_characters(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Characters other than ASCII letters, digits and white space, with counts."""
    chars = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"([^a-zA-Z0-9\s])"), F.lit(1)))
    return df.select(chars.alias("character")).groupBy("character").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "character").limit(top)


def name_traits(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("total"), F.count_distinct(c).alias("distinct"), F.count_if(c.rlike(r"[^a-zA-Z0-9\s]")).alias("special"), F.count_if(c.rlike(r"[À-ÖØ-öø-ÿ]")).alias("accented"), F.count_if(c.contains("-")).alias("hyphenated"))


def field_usage(df: DataFrame, fields: list[str], top: int = 5) -> DataFrame:
    """Per field: values, different ones, the commonest."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("r")).select("r.*").where(~blank(F.col("value")))
    each = rows.groupBy("field", "value").agg(F.count("*").alias("n"))
    ranked = each.withColumn("rank", F.expr("row_number() over (partition by field order by n desc, value)"))
    return ranked.groupBy("field").agg(F.sum("n").alias("used"), F.count("*").alias("distinct"), F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "value")))).alias("t")).select("field", "used", "distinct", F.array_join(F.transform("t", lambda x: x["value"]), "|").alias("commonest"))


def share_of(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    n = F.count_if(F.col(column).isin(*values))
    return df.agg(F.count("*").alias("total"), n.alias("n"), percent(n, F.count("*")).alias("percent"))


def issues(c: Column) -> Column:
    """The first of: empty, broken encoding, suspicious signs; else fine."""
    return F.when(blank(F.trim(c)), "empty").when(c.rlike("Ã|Â|�"), "encoding").when(c.rlike(r"[?*#@|{}\[\]<>]"), "suspicious").otherwise("fine")


def prefix_conflicts(df: DataFrame, code: str, name: str, length: int = 2) -> DataFrame:
    """Code prefixes that stand for several names."""
    return df.where(~blank(F.col(code)) & ~blank(F.col(name))).groupBy(F.substring(code, 1, length).alias("prefix")).agg(F.count_distinct(name).alias("names"), F.count("*").alias("n")).where("names > 1")


def completeness_histogram(c: Column) -> Column:
    """Bin 1 to 4, each open below and closed above; 0 is in none."""
    out = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(BINS, BINS[1:], strict=False), 1):
        out = F.when((c > low) & (c <= high), k).otherwise(out)
    return out


def frequent_groups(df: DataFrame, keys: list[str], least: int = 2, top: int = 20) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least).orderBy(F.desc("frequency"), *keys).limit(top)


def correction_rates(before_after: DataFrame, fields: list[str]) -> DataFrame:
    """Per field (columns x and x_clean): there before, kept by normalization, changed by it."""
    flat = before_after.agg(*(a.alias(f"{f}_{n}") for f in fields for n, a in (("had", F.count_if(~blank(F.col(f)))), ("kept", F.count_if(~blank(F.col(f)) & ~blank(F.col(f"{f}_clean")))), ("changed", F.count_if(F.col(f) != F.col(f"{f}_clean"))))))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), *(F.col(f"{f}_{n}").alias(n) for n in ("had", "kept", "changed"))) for f in fields)))
    return flat.select(rows.alias("r")).select("r.*", percent(F.col("r.kept"), F.col("r.had")).alias("success_percent"), percent(F.col("r.changed"), F.col("r.had")).alias("changed_percent"))


def building_attributes(df: DataFrame, tags: str) -> DataFrame:
    """``attribute, n, percent`` of the buildings that have each common attribute."""
    rows = df.where(has_building(F.col(tags)))
    counts = rows.agg(F.count("*").alias("total"), *(F.count_if(F.map_contains_key(tags, a)).alias(a) for a in BUILDING_ATTRIBUTES))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"`{a}`").alias("n")) for a in BUILDING_ATTRIBUTES)))
    return counts.select("total", each.alias("e")).select("e.attribute", "e.n", percent(F.col("e.n"), F.col("total")).alias("percent"))


def failures(df: DataFrame, raw: str, clean: Column, top: int | None = None) -> DataFrame:
    """``value, n``: raw values that a normalization leaves without a result, the most frequent first; ties by value."""
    out = df.where(F.col(raw).isNotNull() & (F.col(raw) != "") & clean.isNull()).groupBy(F.col(raw).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def named_like(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose name contains the part, whatever its case."""
    return df.where(F.lower(column).contains(part.lower()))
