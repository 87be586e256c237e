"""Words as a table of their own: what is computed of a word is computed once, however often it occurs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import codes
from tessera.functions.stemming import stem


def dictionary(rows: DataFrame, words: str, value: Callable[[Column], Column], name: str) -> DataFrame:
    """``word`` and its ``value`` under ``name``, a row for each different word of the arrays ``words``."""
    return rows.select(F.explode(words).alias("word")).where("word is not null").distinct().select("word", value(F.col("word")).alias(name))


def phonetic_codes(rows: DataFrame, words: str, kind: str) -> DataFrame:
    """``word, code`` by soundex, metaphone, nysiis or double_metaphone."""
    value = F.soundex if kind == "soundex" else codes.on_words(getattr(codes, kind))
    return dictionary(rows, words, value, "code")


def code_sets(rows: DataFrame, key: str, words: str, kind: str) -> DataFrame:
    """``key, codes``: the different codes of each row's words, by the dictionary."""
    each = rows.select(key, F.explode(words).alias("word")).join(phonetic_codes(rows, words, kind), "word")
    return each.where("code <> ''").groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def stems(rows: DataFrame, words: str) -> DataFrame:
    """``word, stem`` by the rules for Portuguese."""
    return dictionary(rows, words, codes.on_words(stem), "stem")


def stemmed(postings: DataFrame, key: str) -> DataFrame:
    """Postings whose terms are stems: those of one stem come together, with all their positions."""
    each = postings.join(postings.select(F.array("term").alias("_w")).transform(lambda d: stems(d, "_w")).withColumnRenamed("word", "term"), "term")
    out = each.groupBy("field", F.col("stem").alias("term"), key).agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.first("dl").alias("dl"))
    return out.select("field", "term", key, "tf", "positions", "dl")


def token_analysis(text: Column, tokens: Column) -> Column:
    """What became of a text: itself, its tokens, how many, how many different ones, the longest."""
    return F.struct(text.alias("original"), tokens.alias("tokens"), F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"), F.array_max(F.transform(tokens, F.length)).alias("longest"))
