"""Readers and writers: element tables, pair files, place lists, results, reports."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.spatial import centroid, parse_point
from tessera.operators.profile import has_address, has_building, parse_tags

ELEMENTS = "id long, type string, tags string, geometry string"
PAIRS = "address_1 string, address_2 string, label int"
ENCODINGS = ("UTF-8", "ISO-8859-1")


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", encoding).csv(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements whose tags and points are text; as a map and two columns. Kept: buildings and whatever has an address tag."""
    rows = read_parquet(spark, path, ELEMENTS).withColumn("tags", parse_tags(F.col("tags"))).withColumn("_p", parse_point(F.col("geometry")))
    return keep_elements(rows.select("id", "type", "tags", F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat")))


def keep_elements(rows: DataFrame, tags: str = "tags") -> DataFrame:
    return rows.where(has_building(F.col(tags)) | has_address(F.col(tags)))


def way_points(ways: DataFrame, ring: str = "nodes") -> DataFrame:
    """Ways with the centroid of their corners (lon, lat) in place of them; null below three corners."""
    return ways.withColumn("_c", centroid(F.filter(F.col(ring), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()))).select("*", F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat")).drop("_c", ring)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PAIRS)


def read_places(spark: SparkSession, path: str, skip: int = 2, column: int = 1, limit: int = 100_000) -> DataFrame:
    """``name``: one column of a small list behind ``skip`` lines, in the first encoding that reads it."""
    raw = spark.read.format("binaryFile").load(path).select("content").first().content
    for encoding in ENCODINGS:
        try:
            text = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    rows = [r[column].strip() for r in list(csv.reader(io.StringIO(text)))[skip:] if len(r) > column and r[column].strip()]
    if len(rows) > limit:
        raise ValueError(f"{len(rows)} places; this is for lists of up to {limit}")
    return spark.createDataFrame([(r,) for r in rows], "name string")


def limited(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(*keys).limit(n)


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Written over what was there, so that a second run does not double the rows."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_checked(df: DataFrame, path: str, bad: Column, quarantine: str) -> None:
    """Good rows to one table, bad ones (a null condition too) to another."""
    write_table(df.where(~F.coalesce(bad, F.lit(True))), path)
    write_table(df.where(F.coalesce(bad, F.lit(True))), quarantine)


def error_report(quarantine: DataFrame, reason: str, top: int = 5) -> DataFrame:
    """The most frequent reasons for which rows were put aside; ties by reason."""
    return quarantine.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason).limit(top)


def write_jdbc(df: DataFrame, url: str, table: str, rows: int = 1000, **properties: str) -> None:
    df.write.mode("overwrite").option("truncate", True).option("batchsize", rows).jdbc(url, table, properties=properties)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def matches_schema(spark: SparkSession, path: str, schema: StructType) -> bool:
    """Whether a table has these columns and types, in any order; false where there is none."""
    try:
        have = spark.read.parquet(path).schema
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    kinds = lambda s: {f.name: f.dataType.simpleString() for f in s}
    return kinds(have) == kinds(schema)


def is_ready(spark: SparkSession, path: str) -> bool:
    """Whether a table is there and has a row."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalog has a table or view of that name."""
    return spark.catalog.tableExists(name)


def latex(rows: DataFrame, caption: str, limit: int = 200) -> str:
    """A report table of up to ``limit`` rows."""
    names = [c.replace("_", " ").title() for c in rows.columns]
    clean = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    body = [" & ".join(map(clean, r)) + r" \\" for r in rows.limit(limit).collect()]
    return "\n".join([r"\begin{table}[ht]", r"\centering", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(names)}}}", r"\hline", " & ".join(names) + r" \\", r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"])


def markdown(rows: DataFrame, limit: int = 200) -> str:
    head = [f"| {' | '.join(rows.columns)} |", "|" + "-|" * len(rows.columns)]
    return "\n".join(head + [f"| {' | '.join('' if x is None else str(x) for x in r)} |" for r in rows.limit(limit).collect()])
