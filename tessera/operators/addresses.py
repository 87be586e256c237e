"""Address records: tags to normalized rows, as one projection, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.functions import text as T
from tessera.functions.spatial import valid
from tessera.operators.profile import address_tags

FIELDS = ("street", "housenumber", "postcode", "city", "country")
#: Fields that completeness counts.
COUNTED = ("street", "housenumber", "postcode", "city")


def extract(elements: DataFrame, tags: str = "tags") -> DataFrame:
    """Elements with any non-empty address tag, those as raw_ columns."""
    rows = elements.withColumn("_address", address_tags(F.col(tags))).where(F.size("_address") > 0)
    return rows.select("*", *(F.element_at("_address", f"addr:{f}").alias(f"raw_{f}") for f in FIELDS)).drop("_address")


def normalize(rows: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """raw_ columns to clean ones and completeness before and after. cities: column city, preprocessed names; without it no city is known."""
    city = T.preprocess(F.col("raw_city"))
    if cities is None:
        named = rows.withColumn("city_clean", F.lit(None).cast("string"))
    else:
        known = cities.select(F.col("city").alias("_known")).distinct()
        named = rows.join(known, city == F.col("_known"), "left").withColumn("city_clean", F.col("_known")).drop("_known")
    number = T.normalize_housenumber(F.col("raw_housenumber"))
    clean = named.select(
        "*", F.when(~T.blank(F.col("raw_street")), T.normalize_street(F.col("raw_street"))).alias("street_clean"),
        T.sane_housenumber(number["primary"]).alias("housenumber_primary"), number["specifier"].alias("housenumber_specifier"),
        T.normalize_postcode(F.col("raw_postcode")).alias("postcode_clean"),
    )
    before = T.completeness(*(F.col(f"raw_{f}") for f in COUNTED))
    after = T.completeness(F.col("street_clean"), F.col("housenumber_primary").cast("string"), F.col("postcode_clean"), F.col("city_clean"))
    return clean.select("*", before.alias("original_completeness"), after.alias("improved_completeness"), F.lit(True).alias("normalization_applied"), F.lit(None).cast("string").alias("municipality"), F.lit(None).cast("string").alias("district"))


def full_address(rows: DataFrame) -> DataFrame:
    """What is searched: street, number, postcode and city that are there."""
    parts = ("street_clean", "housenumber_primary", "postcode_clean", "city_clean")
    return rows.withColumn("full_address", F.concat_ws(" ", *(F.nullif(F.col(c).cast("string"), F.lit("")) for c in parts)))


def display(rows: DataFrame) -> DataFrame:
    """Street with number and specifier, city, postcode."""
    number = F.concat(F.lit(" "), F.col("housenumber_primary").cast("string"), F.coalesce(F.concat(F.lit(" "), F.col("housenumber_specifier")), F.lit("")))
    street = F.when(~T.blank(F.col("street_clean")), F.concat(F.col("street_clean"), F.coalesce(number, F.lit(""))))
    return rows.withColumn("display_address", F.concat_ws(", ", street, F.nullif("city_clean", F.lit("")), F.nullif("postcode_clean", F.lit(""))))


def pair_text(rows: DataFrame) -> DataFrame:
    """One line of at least three components, street and city among them."""
    parts = [F.nullif(F.col(f"raw_{c}"), F.lit("")) for c in ("street", "housenumber", "city", "postcode")]
    enough = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0)) >= 3
    return rows.where(enough & parts[0].isNotNull() & parts[2].isNotNull()).withColumn("address", F.concat_ws(", ", *parts))


def located(rows: DataFrame) -> DataFrame:
    """Points out of range are no points."""
    ok = valid(F.col("lon"), F.col("lat"))
    return rows.withColumn("lon", F.when(ok, F.col("lon"))).withColumn("lat", F.when(ok, F.col("lat")))


def counters(rows: DataFrame, column: str) -> DataFrame:
    """How many values each step of preprocessing changes."""
    steps = T.changes(F.col(column))
    return rows.select(steps.alias("s")).agg(*(F.count_if(F.col(f"s.{n}")).alias(f"{n}_fixes") for n in ("preprocessing", "case", "punctuation", "whitespace", "encoding")))


def build(elements: DataFrame, path: str, cities: DataFrame | None = None, cell: float = 1.0) -> DataFrame:
    """The address table, written over what was there, clustered by place so that boxes read few files; the table."""
    from tessera.functions.spatial import cell as grid

    rows = full_address(normalize(extract(elements), cities))
    rows.repartitionByRange(grid(F.col("lon"), F.col("lat"), cell), "lat").sortWithinPartitions("lat", "lon").write.mode("overwrite").parquet(path)
    return elements.sparkSession.read.schema(rows.schema).parquet(path)


def parse_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with ``parsed_1`` and ``parsed_2``: each different text of both sides is parsed once. A null side is parsed as an empty one."""
    sides = pairs.withColumn("_l", F.coalesce(left, F.lit(""))).withColumn("_r", F.coalesce(right, F.lit("")))
    texts = sides.select(F.explode(F.array("_l", "_r")).alias("_t")).distinct()
    parsed = texts.select("_t", parsing.parse(F.col("_t")).alias("_p"))
    for side, name in (("_l", "parsed_1"), ("_r", "parsed_2")):
        sides = sides.join(parsed.select(F.col("_t").alias(side), F.col("_p").alias(name)), side)
    return sides.drop("_l", "_r")


def pair_coverage(parsed: DataFrame) -> DataFrame:
    """``side`` and the extraction rates of each side of parse_pairs()."""
    sides = parsed.select(F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("parsed_1").alias("p")), F.struct(F.lit(2).alias("side"), F.col("parsed_2").alias("p")))).alias("s")).select("s.*")
    return sides.groupBy("side").agg(*parsing.extraction_rates(F.col("p")))
