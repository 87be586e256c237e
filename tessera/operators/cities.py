"""City names against a canonical list, and groups of similar names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import codes
from tessera.functions.text import preprocess
from tessera.sources.scratch import stored

LEAST = 85
SIMILAR = 0.85


def repair(rows: DataFrame, column: str, canonical: DataFrame, least: int = LEAST) -> DataFrame:
    """``rows`` with city_clean: the canonical name (column name) equal to the preprocessed one, else the most similar of at least ``least``.

    Only distinct names that are not canonical are compared; the canonical list is
    small reference data, which is checked.
    """
    if canonical.count() > 100_000:
        raise ValueError("the canonical list is meant to be a few thousand names")
    known = canonical.select(preprocess(F.col("name")).alias("name")).where("name <> ''").distinct()
    named = rows.withColumn("_city", preprocess(F.col(column)))
    names = named.select("_city").where("_city <> ''").distinct()
    exact = names.join(F.broadcast(known), names["_city"] == known["name"], "left_semi").select("_city", F.col("_city").alias("city_clean"))
    rest = names.join(F.broadcast(known), names["_city"] == known["name"], "left_anti")
    # Beyond eight times the length no ratio reaches the bound.
    near = rest.join(F.broadcast(known), (F.length("name") <= F.length("_city") * 8) & (F.length("_city") <= F.length("name") * 8))
    scored = near.withColumn("score", codes.on_pairs(codes.weighted_ratio, "int")(F.col("_city"), F.col("name"))).where(F.col("score") >= least)
    best = scored.groupBy("_city").agg(F.max_by("name", F.struct(F.col("score"), F.reverse(F.col("name")))).alias("city_clean"))
    return named.join(exact.unionByName(best), "_city", "left").drop("_city")


def similar_names(names: DataFrame, column: str, top: int = 200, least: float = SIMILAR) -> DataFrame:
    """``name, similar, similarity`` of the most frequent names with all others above ``least``, where lengths allow it."""
    counts = names.where(F.col(column).isNotNull() & (F.trim(column) != "")).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "name").limit(top).select("name", F.length("name").alias("_l"))
    others = counts.select(F.col("name").alias("similar"), F.length("name").alias("_m"))
    # 2 M / (a + b) > s needs the shorter length to reach s / (2 - s) of the longer one.
    bound = least / (2 - least)
    pairs = others.join(F.broadcast(first), (F.col("name") != F.col("similar")) & (F.least("_l", "_m") >= F.lit(bound) * F.greatest("_l", "_m")))
    return pairs.withColumn("similarity", codes.on_pairs(codes.sequence_ratio)(F.col("name"), F.col("similar"))).where(F.col("similarity") > least).select("name", "similar", "similarity")


def name_groups(edges: DataFrame) -> DataFrame:
    """``name, group``: connected names under the smallest of them.

    In each round every group takes the smallest name that an edge leads to from it, and chains of groups are shortened by doubling,
    until no edge leaves a group: the rounds grow with the logarithm of the longest chain.
    """
    both = stored(edges.select("name", "similar").unionByName(edges.select(F.col("similar").alias("name"), F.col("name").alias("similar"))).where("name is not null and similar is not null").distinct())
    labels = both.select("name").distinct().withColumn("group", F.col("name"))
    while True:
        ends = both.join(labels, "name").join(labels.select(F.col("name").alias("similar"), F.col("group").alias("_other")), "similar")
        hooks = stored(ends.where("_other < group").groupBy("group").agg(F.min("_other").alias("_to")))
        if hooks.isEmpty():
            return labels
        while True:
            step = stored(hooks.join(hooks.select(F.col("group").alias("_to"), F.col("_to").alias("_next")), "_to", "left").select("group", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_moved")))
            hooks = step.select("group", "_to")
            if step.where("_moved").isEmpty():
                break
        labels = stored(labels.join(hooks, "group", "left").select("name", F.coalesce("_to", "group").alias("group")))
