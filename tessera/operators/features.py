"""Features of address pairs, all column expressions of the two texts and their parsed components."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import bigram_jaccard, entity_jaccard, jaro_winkler_floored, levenshtein, quick

COMPONENTS = ("road", "house_number", "city", "postcode", "normalized")


def pair_scores(a: Column, b: Column, jaro: bool = True) -> dict[str, Column]:
    """jaro: false takes Levenshtein in its place, so that no Arrow function runs."""
    lev, jac = quick(levenshtein)(a, b), bigram_jaccard(a, b)
    jw = quick(jaro_winkler_floored)(a, b) if jaro else lev
    return {"jaro_winkler": jw, "levenshtein": lev, "jaccard": jac}


def combined(df: DataFrame, prefix: str = "phase2_") -> DataFrame:
    """Mean and weighted mean of the three scores, as columns."""
    jw, lev, jac = (F.col(prefix + x) for x in ("jaro_winkler", "levenshtein", "jaccard"))
    return df.withColumn(f"{prefix}average", (jw + lev + jac) / 3).withColumn(f"{prefix}weighted", 0.5 * jw + 0.3 * jac + 0.2 * lev)


def component_scores(left: Callable[[str], Column], right: Callable[[str], Column], similarity=bigram_jaccard) -> dict[str, Column]:
    """Similarity and equality (of what is there) of each component; their mean, most and least."""
    there = lambda c: c.isNotNull() & ~c.isin("", "nan")
    out: dict[str, Column] = {}
    for c in COMPONENTS:
        out[f"comp_{c}_similarity"] = quick(similarity)(left(c), right(c))
        out[f"comp_{c}_exact"] = F.when(there(left(c)) & there(right(c)) & (left(c) == right(c)), 1).otherwise(0)
    each = [out[f"comp_{c}_similarity"] for c in COMPONENTS]
    return out | {"comp_average": reduce(lambda a, b: a + b, each) / len(each), "comp_max": F.greatest(*each), "comp_min": F.least(*each)}


def statistics(a: Column, b: Column) -> dict[str, Column]:
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    digits = lambda c: F.regexp_count(c, F.lit(r"\d"))
    la, lb, wa, wb, da, db = F.length(x), F.length(y), words(x), words(y), digits(x), digits(y)
    return {
        "stat_length_1": la, "stat_length_2": lb, "stat_length_diff": F.abs(la - lb), "stat_length_ratio": F.when(F.greatest(la, lb) > 0, F.least(la, lb) / F.greatest(la, lb)).otherwise(0.0),
        "stat_words_1": wa, "stat_words_2": wb, "stat_words_diff": F.abs(wa - wb), "stat_digits_1": da, "stat_digits_2": db, "stat_digits_equal": (da == db).cast("int"),
    }


def interactions(text: Column, component: Column, entity: Column) -> dict[str, Column]:
    """Products, flags above 0.7, sample variance and mean of three scores."""
    t, c, e = (F.coalesce(x, F.lit(0.0)) for x in (text, component, entity))
    high = [(x > 0.7).cast("int") for x in (t, c, e)]
    mean = (t + c + e) / 3
    return {
        "interact_text_component": t * c, "interact_text_entity": t * e, "interact_component_entity": c * e, "interact_all": t * c * e,
        "interact_text_high": high[0], "interact_component_high": high[1], "interact_entity_high": high[2], "interact_all_high": high[0] * high[1] * high[2], "interact_majority": (high[0] + high[1] + high[2] >= 2).cast("int"),
        "interact_variance": (F.pow(t - mean, F.lit(2)) + F.pow(c - mean, F.lit(2)) + F.pow(e - mean, F.lit(2))) / 2, "interact_mean": mean,
    }


def entities(c: Column, places: list[str] | None = None) -> Column:
    """Runs of capitalised words, in lower case, of more than one character; with ``places`` only those. Stands in for a trained recogniser."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\p{Lu}[\p{L}'-]+(?: (?:d[aeo]s? )?\p{Lu}[\p{L}'-]+)*)"), F.lit(1))
    out = F.array_distinct(F.transform(runs, F.lower))
    return F.filter(out, lambda e: e.isin(*places)) if places else out


def entity_features(x: Column, y: Column) -> dict[str, Column]:
    """Of two arrays of entities."""
    shared, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    n, m = F.size(F.array_distinct(x)), F.size(F.array_distinct(y))
    return {
        "ner_overall_entity_similarity": entity_jaccard(x, y), "ner_count_1": n, "ner_count_2": m, "ner_count_diff": F.abs(n - m), "ner_shared": shared, "ner_union": union,
        "ner_both": (n > 0) & (m > 0), "ner_neither": (n == 0) & (m == 0),
    }


def location_features(whole: tuple[Column, Column], road: tuple[Column, Column], city: tuple[Column, Column]) -> dict[str, Column]:
    """The ten features of place names in two addresses, their roads and their cities; each pair is two arrays of entities."""
    x, y = whole
    n, m = F.size(F.array_distinct(x)), F.size(F.array_distinct(y))
    return {
        "ner_loc_similarity": entity_jaccard(x, y), "ner_road_loc_similarity": entity_jaccard(*road), "ner_city_loc_similarity": entity_jaccard(*city),
        "ner_address1_loc_count": n, "ner_address2_loc_count": m, "ner_entity_count_diff": F.abs(n - m), "ner_has_location_entities": (n > 0) | (m > 0), "ner_both_have_locations": (n > 0) & (m > 0),
        "ner_shared_entities": F.size(F.array_intersect(x, y)), "ner_total_unique_entities": F.size(F.array_union(x, y)),
    }


def class_means(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation and non-zero values of each column; of flags only the last."""
    kinds = dict(df.dtypes)
    flat = []
    for c in columns:
        flag = kinds[c] == "boolean"
        flat += [F.lit(None).cast("double").alias(f"{c}_mean") if flag else F.avg(c).alias(f"{c}_mean"), F.lit(None).cast("double").alias(f"{c}_std") if flag else F.stddev_samp(c).alias(f"{c}_std"), F.count_if(F.col(c) if flag else F.col(c) != 0).alias(f"{c}_n")]
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"), F.col(f"{c}_n").alias("non_zero")) for c in columns)))
    return df.agg(*flat).select(rows.alias("r")).select("r.*")


def bands(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count_if(c > 0.5).alias("high"), F.count_if((c >= 0.2) & (c <= 0.5)).alias("medium"), F.count_if(c < 0.2).alias("low"))


def families(columns: list[str]) -> dict[str, list[str]]:
    """Feature columns by prefix."""
    return {p: [c for c in columns if c.startswith(p)] for p in ("phase2_", "comp_", "ner_", "stat_", "interact_")}
