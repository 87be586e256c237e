"""Ranked search over an inverted index kept as tables: postings, document lengths, field statistics.

Queries come as a DataFrame (query_id, query), so one job answers many: their terms join the postings of those terms only. How many
queries there are is not known, so their sides carry no broadcast hints: the optimizer broadcasts what turns out small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, collapse, let, strip_accents, tokens_of
from tessera.operators import lexicon
from tessera.sources.scratch import stored

K1, B = 1.2, 0.75


def analyze(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words of letters and digits in lower case without accents, but stop words."""
    words = tokens_of(collapse(F.regexp_replace(strip_accents(F.lower(c)), r"(?U)[^\w]+", " ")))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def postings(docs: DataFrame, key: str, fields: list[str], stop: list[str] = STOP_WORDS, stems: bool = False) -> DataFrame:
    """``field, term, key, tf, positions, dl``: dl is the number of the document's words in the field.

    It travels with each posting, so that scores need no join for it. ``stems``: terms are Portuguese stems, and so must those of queries be.
    """
    rows = docs.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), analyze(F.col(f), stop).alias("words")) for f in fields))).alias("f"))
    each = rows.select(key, "f.field", F.size("f.words").cast("long").alias("dl"), F.posexplode("f.words").alias("position", "term"))
    out = each.groupBy("field", "term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"), F.first("dl").alias("dl"))
    return lexicon.stemmed(out, key) if stems else out


def stored_index(docs: DataFrame, key: str, fields: list[str], stop: list[str] = STOP_WORDS) -> DataFrame:
    """The index written once, for all the clauses that read it: ``field, key, dl, parts, counts``, a row for each field of a document.

    ``parts`` has the words in order (of each row, should several have one key), ``counts`` the different terms with their tf. What a clause needs of it
    are rows of postings or of places, made where they are read: only texts go through a shuffle, not a row for each word.
    """
    rows = docs.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), analyze(F.col(f), stop).alias("words")) for f in fields))).alias("f"))
    lines = rows.select(key, "f.*").where(F.size("words") > 0).groupBy(key, "field").agg(F.collect_list(F.array_join("words", " ")).alias("lines"))
    whole = lines.select(key, "field", F.transform("lines", lambda x: F.split(x, " ")).alias("parts"))
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k - 1) != F.get(s, k)))
    runs = lambda s: let(first(s), lambda at: F.transform(at, lambda k, n: F.struct(F.get(s, k).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(s)) - k).cast("long").alias("tf"))))
    return stored(whole.select("field", key, F.size(F.flatten("parts")).cast("long").alias("dl"), "parts", let(F.sort_array(F.flatten("parts")), runs).alias("counts")))


def _counted(index: DataFrame, key: str) -> DataFrame:
    """``field, key, dl, term, tf`` of postings or of a stored index."""
    return index.select("field", key, "dl", F.inline("counts")) if "counts" in index.columns else index.select("field", key, "dl", "term", "tf")


def _placed(index: DataFrame, key: str) -> DataFrame:
    """``field, key, p, term``: a row for each word."""
    if "parts" in index.columns:
        return index.select("field", key, F.explode("parts").alias("words")).select("field", key, F.posexplode("words").alias("p", "term"))
    return index.select("field", key, "term", F.explode("positions").alias("p"))


def _vocabulary(index: DataFrame) -> DataFrame:
    """The index's different terms."""
    return (index.select(F.explode("counts.term").alias("term")) if "counts" in index.columns else index.select("term")).distinct()


def lengths(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy("field", key).agg(F.first("dl").alias("dl"))


def field_stats(docs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """``field, n, avgdl``; a document without words in a field counts in neither."""
    return lengths(index, key).groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """``query_id, at, term``."""
    return queries.select("query_id", F.posexplode(analyze(F.col("query"), stop)).alias("at", "term"))


def bm25(queries: DataFrame, index: DataFrame, key: str, boosts: dict[str, float], stop: list[str] = STOP_WORDS, k1: float = K1, b: float = B, only: DataFrame | None = None) -> DataFrame:
    """``query_id, key, field, score``: idf = ln(1 + (n - df + 0.5) / (df + 0.5)), times the field's boost.

    ``only``: ``query_id, key, field`` to score. A stored index is dealt by document before its terms meet the queries, so that scores are summed in place.
    """
    terms = query_terms(queries, stop).select("query_id", "term").distinct()
    mine = index.where(F.col("field").isin(*boosts))
    stats = lengths(mine, key).groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # a row for each field
    wanted = lambda rows: _counted(rows, key).join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted(mine).groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = stored(df.join(F.broadcast(stats), "field").select("field", "term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    boost = F.element_at(F.create_map(*(x for f, w in boosts.items() for x in (F.lit(f), F.lit(float(w))))), F.col("field"))
    one = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * boost
    if only is not None:
        mine = mine.join(only.select("field", key).distinct(), ["field", key], "left_semi")
    elif "counts" in mine.columns:
        mine = mine.select("field", key, "dl", "counts").repartition(int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    hits = _counted(mine, key).join(idf, ["field", "term"]).select("term", key, "field", one.alias("one")).join(terms, "term")
    if only is not None:
        hits = hits.join(only, ["query_id", key, "field"], "left_semi")
    return hits.groupBy("query_id", key, "field").agg(F.sum("one").alias("score"))


def best_field(scores: DataFrame, key: str, boost: float = 1.0) -> DataFrame:
    return scores.groupBy("query_id", key).agg((F.max("score") * boost).alias("score"))


def top_k(scores: DataFrame, key: str, k: int, least: float = 0.0) -> DataFrame:
    """The k best of each query, ties by key; with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scores.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k)


def _phrases(terms: DataFrame, index: DataFrame, key: str, fields: list[str], slop: int) -> DataFrame:
    """terms: query_id, at, term; several terms at one place stand for each other.

    A phrase is sought where the rarest of its places occurs; the other places are looked up there only.
    """
    mine = index.where(F.col("field").isin(*fields))
    terms = stored(terms.select("query_id", "at", "term").distinct())
    often = _counted(mine, key).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("tf").alias("often"))
    places = terms.join(often, "term", "left").groupBy("query_id", "at").agg(F.coalesce(F.sum("often"), F.lit(0)).alias("often"))
    rarest = places.groupBy("query_id").agg(F.min_by("at", F.struct("often", "at")).alias("at"), F.count("*").alias("n"))
    anchors = stored(terms.join(rarest, ["query_id", "at"]))
    words = _placed(mine, key)
    base = F.explode(F.sequence(F.col("p") - F.col("at") - slop, F.col("p") - F.col("at"))) if slop else F.col("p") - F.col("at")
    begun = stored(words.join(anchors, "term").select("query_id", key, "field", "n", base.alias("base")).distinct())
    # Only documents that have a beginning are read on.
    p = F.explode(F.sequence(F.col("base") + F.col("at"), F.col("base") + F.col("at") + slop)) if slop else F.col("base") + F.col("at")
    asked = stored(begun.join(terms, "query_id").select("query_id", key, "field", "n", "base", "at", "term", p.alias("p")))
    held = _placed(mine.join(begun.select(key).distinct(), key, "left_semi"), key)
    met = held.join(asked, [key, "field", "term", "p"]).groupBy("query_id", key, "field", "base", "n").agg(F.count_distinct("at").alias("met"))
    return met.where("met = n").select("query_id", key, "field").distinct()


def phrase_hits(queries: DataFrame, index: DataFrame, key: str, fields: list[str], slop: int = 0, stop: list[str] = STOP_WORDS) -> DataFrame:
    """``query_id, key, field``: all terms of the query at their distances, each up to ``slop`` places off."""
    return _phrases(query_terms(queries, stop), index, key, fields, slop)


def phrase_clause(queries: DataFrame, index: DataFrame, key: str, boosts: dict[str, float], boost: float = 5.0, **options) -> DataFrame:
    """Best field's score of documents that hold the phrase."""
    return best_field(bm25(queries, index, key, boosts, **options, only=stored(phrase_hits(queries, index, key, list(boosts), **options))), key, boost)


def edits_allowed(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 3, 0).when(n <= 5, 1).otherwise(2)


def fuzzy_terms(queries: DataFrame, index: DataFrame, prefix: int = 2, stop: list[str] = STOP_WORDS) -> DataFrame:
    """``query_id, term, variant, edits``: terms of the index that begin alike and are few edits away."""
    words = _vocabulary(index).withColumnRenamed("term", "variant").withColumn("_p", F.substring("variant", 1, prefix))
    terms = query_terms(queries, stop).select("query_id", "term").distinct().withColumn("_p", F.substring("term", 1, prefix))
    close = F.abs(F.length("variant") - F.length("term")) <= edits_allowed(F.col("term"))
    edits = F.levenshtein("term", "variant", 2)
    return words.join(terms, "_p").where(close).withColumn("edits", edits).where((F.col("edits") >= 0) & (F.col("edits") <= edits_allowed(F.col("term")))).select("query_id", "term", "variant", "edits")


def fuzzy_clause(queries: DataFrame, index: DataFrame, key: str, boosts: dict[str, float], boost: float = 2.0, prefix: int = 2, **options) -> DataFrame:
    """Best field's score of the query with its terms' variants added."""
    variants = fuzzy_terms(queries, index.where(F.col("field").isin(*boosts)), prefix)
    wide = variants.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("variant")), " ").alias("query"))
    return best_field(bm25(wide, index, key, boosts, **options), key, boost)


def cross_fields_hits(queries: DataFrame, index: DataFrame, key: str, fields: list[str], stop: list[str] = STOP_WORDS) -> DataFrame:
    """``query_id, key``: every term is in some field."""
    terms = query_terms(queries, stop).select("query_id", "term").distinct()
    n = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    met = _counted(index.where(F.col("field").isin(*fields)), key).join(terms, "term").groupBy("query_id", key).agg(F.count_distinct("term").alias("met"))
    return met.join(n, "query_id").where("met = n").select("query_id", key)


def cross_fields_clause(queries: DataFrame, index: DataFrame, key: str, fields: list[str], boost: float = 1.0, **options) -> DataFrame:
    scores = bm25(queries, index, key, dict.fromkeys(fields, 1.0), **options)
    return best_field(scores.join(cross_fields_hits(queries, index, key, fields), ["query_id", key], "left_semi"), key, boost)


def term_clause(queries: DataFrame, docs: DataFrame, key: str, field: str, boost: float = 3.0) -> DataFrame:
    """The whole query equals the field."""
    return docs.select(key, F.col(field).alias("query")).join(queries, "query").select("query_id", key, F.lit(float(boost)).alias("score"))


def should(clauses: list[DataFrame], key: str) -> DataFrame:
    """Documents of any clause, with the sum of their scores."""
    rows = reduce(lambda a, b: a.unionByName(b), (c.select("query_id", key, "score") for c in clauses))
    return rows.groupBy("query_id", key).agg(F.sum("score").alias("score"))


def prefix_terms(queries: DataFrame, index: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """``query_id, term``: all terms that begin as the query's last one."""
    last = queries.select("query_id", F.element_at(analyze(F.col("query"), stop), -1).alias("_l")).where("_l is not null")
    words = _vocabulary(index)
    begins = words.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.left("term", n))).alias("_l"))
    return begins.join(last, "_l").select("query_id", "term")


def phrase_prefix_hits(queries: DataFrame, index: DataFrame, key: str, fields: list[str], slop: int = 2, stop: list[str] = STOP_WORDS) -> DataFrame:
    """Phrases whose last term may be the beginning of a word, terms up to ``slop`` places off."""
    terms = query_terms(queries, stop)
    last = terms.groupBy("query_id").agg(F.max("at").alias("last"))
    ends = prefix_terms(queries, index, stop).join(last, "query_id").select("query_id", F.col("last").alias("at"), "term")
    fixed = terms.join(last, "query_id").where("at < last").select("query_id", "at", "term")
    return _phrases(fixed.unionByName(ends), index, key, fields, slop).select("query_id", key).distinct()


def naive(docs: DataFrame, key: str, columns: list[str], query: str, limit: int = 50) -> DataFrame:
    """Documents in which every term of at least two characters is in some column; the first by key."""
    terms = [t for t in query.lower().replace(",", " ").split() if len(t) >= 2]
    text = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    every = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (c.contains(t) for c in text)) for t in terms), F.lit(bool(terms)))
    return docs.where(every).orderBy(key).limit(limit)


def confidence(score: Column, completeness: Column) -> Column:
    """A missing or zero completeness counts as a half."""
    return 0.7 * score + 0.3 * F.coalesce(F.nullif(completeness, F.lit(0.0)), F.lit(0.5))


def band(c: Column) -> Column:
    return F.when(c >= 50, "high").when(c >= 20, "medium").otherwise("low")


def lookup(hits: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the hits."""
    return table.join(hits, keys)


def two_phase(queries: DataFrame, docs: DataFrame, index: DataFrame, key: str, street: str, city: str, full: str, postcode: str, k: int = 10, least: float = 0.1) -> DataFrame:
    """The best 2 k by text, then their rows, confidence, and the best k."""
    fields = {street: 3.0, city: 2.0, full: 1.0}
    clauses = [
        phrase_clause(queries, index, key, fields, 5.0),
        fuzzy_clause(queries, index, key, {street: 2.0, city: 1.5, full: 1.0}, 2.0),
        cross_fields_clause(queries, index, key, [street, city, postcode, full], 1.0),
        term_clause(queries, docs, key, postcode, 3.0),
    ]
    first = top_k(should(clauses, key), key, 2 * k, least)
    rows = lookup(first, docs, [key])
    return rows.withColumn("confidence", confidence(F.col("score"), F.col("improved_completeness"))).where(F.col("rank") <= k)
