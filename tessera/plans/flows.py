"""Queries for sources, sinks and streams: what goes through them must come out the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import addresses
from tessera.operators.pairs import sample
from tessera.plans.base import EL, elements, query, table
from tessera.plans.texts import _NORMALIZED, _SHOWN
from tessera.functions.text import preprocess
from tessera.sources import tables
from tessera.sources.scratch import folder
from tessera.streaming import streams

@query("select n_nationkey, n_name, n_regionkey from nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    tables.write_csv(table(spark, sf_dir, "nation"), path)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("select doc_id, text from documents")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    tables.write_json(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return tables.read_json(spark, path, "doc_id long, text string")


@query(f"with {EL} select id, type, street, number, postcode, city from el")
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    tables.write_table(elements(spark, sf_dir).select("id", "type", "street", "number", "postcode", "city"), path, ["type"])
    return spark.read.parquet(path).select("id", "type", "street", "number", "postcode", "city")


@query(f"with {_NORMALIZED} select id, street_clean, postcode_clean, city_clean from nm")
def address_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements to the stored address table."""
    rows = elements(spark, sf_dir).select("id", "tags", "lon", "lat")
    known = addresses.extract(rows).select(preprocess(F.col("raw_city")).alias("city")).where("city like 'vila%'").distinct()
    return addresses.build(rows, folder(spark), known).select("id", "street_clean", "postcode_clean", "city_clean")


@query(f"with {EL} select count(*) filter (where street is not null) as good, count(*) filter (where street is null) as bad from el")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = folder(spark), folder(spark)
    tables.write_checked(elements(spark, sf_dir).select("id", "street"), good, F.col("street").isNull(), bad)
    count = lambda p, n: spark.read.parquet(p).agg(F.count("*").alias(n))
    return count(good, "good").crossJoin(count(bad, "bad"))


@query("select o_orderkey from orders order by o_orderkey limit 100")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.limited(table(spark, sf_dir, "orders"), 100, "o_orderkey").select("o_orderkey")


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator that takes 100 rows."""
    return sample(table(spark, sf_dir, "orders"), 100, "o_orderkey").select("o_orderkey")


@query("select window_start, window_start + interval 1 hour as window_end, event_type, count(*) as n from (select date_trunc('hour', ts) as window_start, event_type from events) group by 1, 2, 3")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, counted by hour and type; a last empty batch closes the windows that the watermark has not."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source, out = folder(spark), folder(spark)
    events.coalesce(1).write.parquet(source)
    late = events.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).withColumn("event_type", F.lit(None).cast("string"))
    check = folder(spark)
    streams.run_once(streams.windowed_counts(streams.files(spark, source, events.schema), "ts", ["event_type"]), out, check)
    late.coalesce(1).write.mode("append").parquet(source)
    streams.run_once(streams.windowed_counts(streams.files(spark, source, events.schema), "ts", ["event_type"]), out, check)
    late.coalesce(1).write.mode("append").parquet(source)
    streams.run_once(streams.windowed_counts(streams.files(spark, source, events.schema), "ts", ["event_type"]), out, check)
    return spark.read.parquet(out).where("event_type is not null").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


@query(f"with {_NORMALIZED} select {_SHOWN.replace('city_clean', 'cast(null as varchar) as city_clean').replace(', cast(original_completeness as double) as original_completeness, cast(improved_completeness as double) as improved_completeness', '')} from nm")
def stream_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same projection on a stream of elements."""
    rows = elements(spark, sf_dir).select("id", "tags")
    source, out = folder(spark), folder(spark)
    rows.write.parquet(source)
    streams.run_once(streams.normalized(streams.files(spark, source, rows.schema)), out, folder(spark))
    return spark.read.parquet(out).selectExpr(*_SHOWN.split(", ")[:6])
