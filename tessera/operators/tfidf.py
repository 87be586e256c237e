"""TF-IDF over a corpus as long tables, and the cosine of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import ngrams
from tessera.functions.text import tokenize, tokens_of

FEATURES, MOST = 1000, 0.95


def terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf`` of words and pairs of words."""
    words = ngrams(tokens_of(F.array_join(tokenize(F.col(text)), " ")))
    return texts.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, n: int, features: int = FEATURES, most: float = MOST) -> DataFrame:
    """``term, idf`` of the most frequent terms that are not in more than a share ``most`` of the n texts; ties by term. idf = ln((1 + n) / (1 + df)) + 1."""
    each = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") <= most * n)
    kept = each.orderBy(F.desc("total"), "term").limit(features)
    return kept.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))


def weights(texts: DataFrame, key: str, text: str, features: int = FEATURES, most: float = MOST) -> DataFrame:
    """``key, term, weight`` with rows of length 1."""
    tf = terms(texts, key, text)
    each = tf.join(F.broadcast(vocabulary(tf, texts.count(), features, most)), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return each.select(key, "term", (F.col("w") / norm).alias("weight"))


def pair_cosine(pairs: DataFrame, key: str, a: str, b: str, **options) -> DataFrame:
    """``key, tfidf``: the corpus is the distinct texts of both sides. Two texts without tokens are equal, one is not similar."""
    both = pairs.select(key, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col(a).alias("text")), F.struct(F.lit(2).alias("side"), F.col(b).alias("text")))).alias("x")).select(key, "x.*")
    corpus = both.select("text").distinct()
    w = weights(corpus, "text", "text", **options)
    sides = both.join(w, "text").select(key, "side", "term", "weight")
    dot = sides.groupBy(key, "term").agg(F.sum(F.when(F.col("side") == 1, F.col("weight"))).alias("x"), F.sum(F.when(F.col("side") == 2, F.col("weight"))).alias("y")).groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    empty = lambda c: F.size(tokenize(F.col(c))) == 0
    score = F.when(empty(a) & empty(b), 1.0).when(empty(a) | empty(b), 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("dot", F.lit(0.0))))
    return pairs.join(dot, key, "left").select(key, score.alias("tfidf"))
