"""Address strings to components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import normalize_street, preprocess, title

# Where a house number may stand, in order, and words that begin no city.
HOUSE_NUMBER = (r",\s*(\d+\s*[a-zA-Z]?)\s*,", r",\s*(\d+\s*[a-zA-Z]?)\s*$", r"\s(\d+\s*[a-zA-Z]?)\s*,", r"\s(\d+\s*[a-zA-Z]?)\s+[a-zA-Z]")
NO_CITY = ("rua", "avenida", "travessa", "estrada", "largo", "praca", "praça", "beco", "tv", "av")
POSTCODE = r"\b(\d{4}-\d{3})\b"


def postcode_of(c: Column) -> Column:
    return F.regexp_extract(c, POSTCODE, 1)


def housenumber_of(c: Column) -> Column:
    """The first pattern that matches the text as it is, else as preprocess() leaves it; empty if none does."""
    tries = [F.nullif(F.trim(F.regexp_extract(x, p, 1)), F.lit("")) for x in (c, preprocess(c)) for p in HOUSE_NUMBER]
    return F.coalesce(*tries, F.lit(""))


def road_of(c: Column, postcode: Column, number: Column) -> Column:
    """What stands before the first comma, without postcode and without every occurrence of the number."""
    road = F.split_part(c, F.lit(","), F.lit(1))
    road = F.when(postcode != "", F.replace(road, postcode, F.lit(""))).otherwise(road)
    road = F.when(number != "", F.replace(road, number, F.lit(""))).otherwise(road)
    return normalize_street(F.trim(road))


def city_of(c: Column, postcode: Column, number: Column, compat: bool = True) -> Column:
    """The last part between commas that can be a city; compat: words merely beginning as a street prefix can't."""
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p))  # trim itself would take the index as its second argument

    def fits(p: Column) -> Column:
        low = F.lower(p)
        street = F.lit(False)
        for w in NO_CITY:
            street = street | (low.startswith(w) if compat else low.rlike(rf"^{w}\.?(\s|$)"))
        return (F.trim(F.regexp_replace(p, r"\d", "")) != "") & ~((postcode != "") & p.contains(postcode)) & ~((number != "") & (p == number)) & ~street

    found = F.get(F.filter(F.reverse(parts), fits), 0)
    named = title(preprocess(F.trim(F.regexp_replace(found, r"\d", ""))))
    return F.when((F.size(parts) >= 2) & found.isNotNull(), named).otherwise("")


def parse(c: Column, compat: bool = True) -> Column:
    """road, house_number, city, postcode, original, normalized; empty strings where a component is missing."""
    text = F.coalesce(c, F.lit(""))
    postcode, number = postcode_of(text), housenumber_of(text)
    return F.struct(road_of(text, postcode, number).alias("road"), number.alias("house_number"), city_of(text, postcode, number, compat).alias("city"), postcode.alias("postcode"), text.alias("original"), preprocess(text).alias("normalized"))


def extraction_rates(parsed: Column) -> list[Column]:
    """Percentages of non-empty components; complete: road and city."""
    rate = lambda cond: F.avg(cond.cast("int")) * 100
    return [rate(parsed[x] != "").alias(f"{x}_rate") for x in ("road", "house_number", "city", "postcode")] + [rate((parsed["road"] != "") & (parsed["city"] != "")).alias("complete_rate")]
