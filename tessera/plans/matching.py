"""Queries for similarities, pairs, evaluation and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions.text import tokenize
from tessera.operators import evaluate as E
from tessera.operators import features as X
from tessera.operators import pairs as G
from tessera.operators import statistics as V
from tessera.operators import tfidf
from tessera.operators.evaluate import search_test_cases
from tessera.plans.base import ADDRESS, EL, PAIRS, elements, jaccard, levenshtein, name_pairs, phonetic, query, table, tokens

_TOK = f"tk as (select brand, a, b, {tokens('a')} as x, {tokens('b')} as y from pr)"
_LEV, _JAC = levenshtein("a", "b"), jaccard("x", "y")
_TOP = f"""with {PAIRS}, {_TOK}, sc as (select brand, a, b, round(0.4 * ({_LEV}) + 0.6 * ({_JAC}), 6) as score from tk),
rk as (select *, row_number() over (partition by brand, a order by score desc, b) as k from sc where score >= 0.5)
select brand, a as left_name, b as right_name, score from rk where k = 1"""


def match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's best match within its brand."""
    score = F.round(S.weighted({"levenshtein": 0.4, "jaccard": 0.6}, {k: S.score(k, F.col("a"), F.col("b")) for k in ("levenshtein", "jaccard")}), 6)
    scored = name_pairs(spark, sf_dir).withColumn("score", score).where("score >= 0.5")
    rank = F.expr("row_number() over (partition by brand, a order by score desc, b)")
    return scored.withColumn("k", rank).where("k = 1").select("brand", F.col("a").alias("left_name"), F.col("b").alias("right_name"), "score")


@query(_TOP)
def match_parts_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_names(spark, sf_dir)


def _scored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("brand", "a", "b", F.round(S.score(name, F.col("a"), F.col("b")), 6).alias("score"))


@query(f"with {PAIRS} select brand, a, b, round({_LEV}, 6) as score from pr")
def sim_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "levenshtein")


@query(f"with {PAIRS} select brand, a, b, {_LEV} >= 0.6 as similar from pr")
def sim_levenshtein_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("brand", "a", "b", S.levenshtein_at_least(F.col("a"), F.col("b"), 0.6).alias("similar"))


@query(f"with {PAIRS}, {_TOK} select brand, a, b, round({_JAC}, 6) as score from tk")
def sim_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "jaccard")


_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_BIGRAM = f"case when x = y then 1.0 else cast(len(list_intersect({_GRAMS.format('x')}, {_GRAMS.format('y')})) as double) / len(list_distinct(list_concat({_GRAMS.format('x')}, {_GRAMS.format('y')}))) end"


@query(f"with {PAIRS}, q as (select brand, a, b, lower(trim(a)) as x, lower(trim(b)) as y from pr) select brand, a, b, round({_BIGRAM}, 6) as score from q")
def sim_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "bigram")


# Names are two words each, so a pair's vocabulary has at most six terms, and none twice.
_PAIR_TFIDF = f"""g as (select brand, a, b, list_concat(x, [array_to_string(x, ' ')]) as x, list_concat(y, [array_to_string(y, ' ')]) as y from tk),
n as (select *, len(list_intersect(x, y)) as c from g)
select brand, a, b, round(c / (sqrt(c + (len(x) - c) * power(ln(1.5) + 1, 2)) * sqrt(c + (len(y) - c) * power(ln(1.5) + 1, 2))), 6) as score from n"""


@query(f"with {PAIRS}, {_TOK}, {_PAIR_TFIDF}")
def sim_tfidf_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "tfidf")


_CORPUS = f"""p as (select brand, a, b from pr), u as (select distinct t from (select a as t from p union all select b from p)),
w as (select t, {tokens('t')} as x from u), g as (select t, unnest(list_concat(x, case when len(x) > 1 then list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]) else [] end)) as term from w),
tf as (select t, term, count(*) as tf from g group by 1, 2), n as (select count(*) as n from u),
v as (select term, count(*) as df, sum(tf) as total from tf group by term having count(*) <= 0.95 * (select n from n) order by total desc, term limit 1000),
z as (select t, term, tf * (ln((1.0 + (select n from n)) / (1.0 + df)) + 1) as w from tf join v using (term)),
y as (select t, term, w / sqrt(sum(w * w) over (partition by t)) as w from z),
d as (select p.brand, p.a, p.b, sum(k.w * l.w) as dot from p join y k on k.t = p.a join y l on l.t = p.b and l.term = k.term group by 1, 2, 3)
select p.brand, p.a, p.b, round(least(1.0, coalesce(dot, 0.0)), 6) as score from p left join d on d.brand = p.brand and d.a = p.a and d.b = p.b"""


@query(f"with {PAIRS}, {_CORPUS}")
def sim_tfidf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = name_pairs(spark, sf_dir).withColumn("key", F.concat_ws("|", "brand", "a", "b"))
    return pairs.join(tfidf.pair_cosine(pairs, "key", "a", "b"), "key").select("brand", "a", "b", F.round("tfidf", 6).alias("score"))


_CODES = """ws as (select distinct unnest({0}) as w from (select a as t from pr union select b from pr)),
s0 as (select w, upper(w) as u from ws), s1 as (select w, substr(u, 1, 1) as f, translate(substr(u, 1, 1), 'HW', '99') || regexp_replace(substr(u, 2), '[HW]', '', 'g') as r from s0),
s2 as (select w, f, translate(r, 'ABCDEFGIJKLMNOPQRSTUVXYZ', '012301202245501262301202') as r from s1),
s3 as (select w, f, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') as r from s2),
cd as (select w, f || rpad(substr(replace(substr(r, 2), '0', ''), 1, 3), 3, '0') as code from s3),
tc as (select t, list(distinct code) as codes from (select t, unnest({0}) as w from (select a as t from pr union select b from pr)) join cd using (w) group by t)""".format(phonetic("t"))


@query(f"with {PAIRS}, {_CODES}, j as (select brand, a, b, coalesce(k.codes, []) as x, coalesce(l.codes, []) as y from pr left join tc k on k.t = a left join tc l on l.t = b) select brand, a, b, round(case when len(x) = 0 or len(y) = 0 then 0.0 else {jaccard('x', 'y')} end, 6) as score from j")
def sim_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "soundex")


@query(f"with {PAIRS} select brand, a, b, round(jaro_winkler_similarity(a, b), 6) as score from pr")
def sim_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "jaro_winkler_floored")


@query(f"with {PAIRS} select brand, a, b, case when lower(trim(a)) = lower(trim(b)) then 1.0 else 0.0 end as score from pr")
def sim_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "exact")


def _no_sql(name: str, key: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scored(spark, sf_dir, key)

    run.__name__ = name
    query()(run)


for _name, _key in (("sim_jaro_winkler_half", "jaro_winkler"), ("sim_jaro_half", "jaro"), ("sim_metaphone", "metaphone"), ("sim_nysiis", "nysiis"), ("sim_double_metaphone", "double_metaphone"), ("sim_sequence", "sequence")):
    _no_sql(_name, _key)


@query()
def sim_fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("brand", "a", "b", S.fuzzy_best(F.col("a"), F.col("b")).alias("percent"))


@query()
def sim_hybrids(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sorted({k for w in S.HYBRIDS.values() for k in w})
    scored = name_pairs(spark, sf_dir).select("brand", "a", "b", *(S.score(k, F.col("a"), F.col("b")).alias(k) for k in base))
    return E.hybrid_scores(scored, S.HYBRIDS).select("brand", "a", "b", *(F.round(n, 6).alias(n) for n in S.HYBRIDS))


#: Labelled scores: names that share their first word match.
_SCORES = f"sc as (select case when string_split(a, ' ')[1] = string_split(b, ' ')[1] then 1 else 0 end as label, {_LEV} as levenshtein, {_JAC} as jaccard, brand, a, b from tk)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c: F.get(F.split(c, " "), 0)
    return name_pairs(spark, sf_dir).select(F.when(first("a") == first("b"), 1).otherwise(0).alias("label"), *(S.score(k, F.col("a"), F.col("b")).alias(k) for k in ("levenshtein", "jaccard")), "brand", "a", "b")


def _metrics(score: str, label: str, t: str) -> str:
    tp, fp, fn, tn = (f"count(*) filter (where {c})" for c in (f"{score} >= {t} and {label} = 1", f"{score} >= {t} and {label} = 0", f"{score} < {t} and {label} = 1", f"{score} < {t} and {label} = 0"))
    div = lambda a, b: f"case when {b} > 0 then cast({a} as double) / ({b}) else 0.0 end"
    return ", ".join((
        f"{div(tp, f'({tp} + {fp})')} as precision", f"{div(tp, f'({tp} + {fn})')} as recall", f"{div(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} as f1_score", f"{div(f'({tp} + {tn})', 'count(*)')} as accuracy",
        f"{tp} as true_positives", f"{fp} as false_positives", f"{fn} as false_negatives", f"{tn} as true_negatives",
        f"round(coalesce(avg({score}) filter (where {label} = 1), 0.0), 9) as mean_similarity_positive", f"round(coalesce(avg({score}) filter (where {label} = 0), 0.0), 9) as mean_similarity_negative",
        f"round(coalesce(avg({score}) filter (where {label} = 1), 0.0) - coalesce(avg({score}) filter (where {label} = 0), 0.0), 9) as similarity_separation",
    ))


_MEANS = ("mean_similarity_positive", "mean_similarity_negative", "similarity_separation")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if c in _MEANS else F.col(c) for c in df.columns))


@query(f"with {PAIRS}, {_TOK}, {_SCORES} select {_metrics('jaccard', 'label', '0.3')} from sc")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.evaluate(scores(spark, sf_dir).select(F.col("jaccard").alias("score"), "label"), 0.3))


# Scores are rounded on both sides, so that no last digit decides at a threshold.
_SWEEP = f"lg as (select label, 'levenshtein' as algorithm, round(levenshtein, 9) as score from sc union all select label, 'jaccard', round(jaccard, 9) from sc), gd as (select 0.1e0 + 0.05e0 * i as threshold from range(0, 18) t(i)), sw as (select algorithm, threshold, {_metrics('score', 'label', 'threshold')} from lg, gd group by algorithm, threshold)"


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.long_scores(scores(spark, sf_dir), ["levenshtein", "jaccard"]).withColumn("score", F.round("score", 9))
    return E.threshold_sweep(rows)


@query(f"with {PAIRS}, {_TOK}, {_SCORES}, {_SWEEP} select algorithm, round(threshold, 6) as threshold, * exclude (algorithm, threshold) from sw")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_sweep(spark, sf_dir)).withColumn("threshold", F.round("threshold", 6))


@query(f"with {PAIRS}, {_TOK}, {_SCORES}, {_SWEEP}, r as (select *, row_number() over (partition by algorithm order by f1_score desc, threshold) as k from sw) select algorithm, round(threshold, 6) as threshold, f1_score from r where k = 1 order by f1_score desc, algorithm")
def method_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranking(E.best_thresholds(_sweep(spark, sf_dir))).withColumn("threshold", F.round("threshold", 6))


_GRID = "wg as (select i / 10.0e0 as u, (10 - i) / 10.0e0 as v from range(1, 10) t(i)), ws as (select u, v, label, round(levenshtein * u + jaccard * v, 9) as score from sc, wg)"


@query(f"with {PAIRS}, {_TOK}, {_SCORES}, {_GRID}, m as (select u as weight_levenshtein, v as weight_jaccard, {_metrics('score', 'label', '0.45')} from ws group by u, v) select weight_levenshtein, weight_jaccard, precision, recall, f1_score from m")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return E.weight_grid(rows, ["levenshtein", "jaccard"], 0.45 - 5e-10)


@query(f"with {PAIRS}, {_TOK}, {_SCORES}, rk as (select brand, a, label, row_number() over (partition by brand, a order by round(0.4 * levenshtein + 0.6 * jaccard, 6) desc, b) as rank from sc), fh as (select brand, a, min(case when label = 1 then rank end) as f from rk group by 1, 2) select count(*) as queries, avg(case when f <= 1 then 1.0 else 0.0 end) as top_1, avg(case when f <= 3 then 1.0 else 0.0 end) as top_3, avg(case when f <= 5 then 1.0 else 0.0 end) as top_5 from fh")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("s", F.round(0.4 * F.col("levenshtein") + 0.6 * F.col("jaccard"), 6)).withColumn("query_id", F.concat_ws("|", "brand", "a"))
    ranked = rows.withColumn("rank", F.expr("row_number() over (partition by query_id order by s desc, b)")).withColumn("is_match", F.col("label") == 1)
    return E.top_k_accuracy(ranked)


_P = "cast(p_size * 2 + 1 as double)"


def _grade(p: str, c: str) -> str:
    e, g, h, m = map(float, S.GRADES[c])
    return f"case when {p} >= {e} then 1.0 when {p} >= {g} then 0.7 + 0.3 * ({p} - {g}) / ({e} - {g}) when {p} >= {h} then 0.4 + 0.3 * ({p} - {h}) / ({g} - {h}) when {p} >= {m} then 0.1 + 0.3 * ({p} - {m}) / ({h} - {m}) else 0.0 end"


@query(f"with g as (select p_partkey, {_grade(_P, 'street')} as street, {_grade(_P, 'city')} as city, {_grade(_P, 'postcode')} as postcode from part), w as (select *, case when p_partkey % 4 = 0 then (0.5 * street + 0.35 * city) / 0.85 else 0.5 * street + 0.35 * city + 0.15 * postcode end as grade from g) select p_partkey, round(street, 6) as street, round(city, 6) as city, round(postcode, 6) as postcode, round(grade, 6) as grade, round(grade, 9) >= 0.6 as matched from w")
def graded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("p_size") * 2 + 1).cast("double")
    grades = {c: S.graded(p, c) for c in S.GRADES}
    wanted = {c: F.when(F.lit(c != "postcode") | (F.col("p_partkey") % 4 != 0), F.lit("x")) for c in S.GRADES}
    grade, _ = E.graded_match(grades, wanted)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(g, 6).alias(c) for c, g in grades.items()), F.round(grade, 6).alias("grade"), (F.round(grade, 9) >= S.GRADE_MATCH).alias("matched"))


@query("select p_partkey, ((case when contains(lower(p_name), 'red') then 1 else 0 end) + (case when contains(lower(p_brand), 'brand#1') then 1 else 0 end) + (case when p_type = 'SMALL' then 1 else 0 end)) >= 3 * 0.7 as matched from part")
def strict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {"street": F.col("p_name"), "city": F.col("p_brand"), "postcode": F.col("p_type")}
    match = E.strict_match(found, {"street": F.lit("red"), "city": F.lit("Brand#1"), "postcode": F.lit("SMALL")})
    return table(spark, sf_dir, "part").select("p_partkey", match.alias("matched"))


@query("""with s as (select l_returnflag, l_linestatus, cast(l_quantity as double) as v from lineitem), o as (select *, row_number() over (partition by l_returnflag, l_linestatus order by v) as k, count(*) over (partition by l_returnflag, l_linestatus) as c from s),
q as (select l_returnflag, l_linestatus, c as n, avg(v) as mean, median(v) as median, coalesce(stddev_samp(v), 0) as std, min(v) as min, max(v) as max,
max(v) filter (where k = greatest(1, least(c - 1, cast(floor(0.95 * (c + 1)) as bigint)))) as a95, max(v) filter (where k = 1 + greatest(1, least(c - 1, cast(floor(0.95 * (c + 1)) as bigint)))) as b95, max(v) filter (where k = greatest(1, least(c - 1, cast(floor(0.99 * (c + 1)) as bigint)))) as a99, max(v) filter (where k = 1 + greatest(1, least(c - 1, cast(floor(0.99 * (c + 1)) as bigint)))) as b99 from o group by 1, 2, 3)
select l_returnflag, l_linestatus, n, round(mean, 6) as mean, median, round(std, 6) as std, min, max, round(case when n < 20 then max else a95 + (b95 - a95) * (0.95 * (n + 1) - floor(0.95 * (n + 1))) end, 6) as p95, round(case when n < 100 then max else a99 + (b99 - a99) * (0.99 * (n + 1) - floor(0.99 * (n + 1))) end, 6) as p99 from q""")
def latency_percentiles_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.latency_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.select("l_returnflag", "l_linestatus", "n", *(F.round(c, 6).alias(c) for c in ("mean",)), "median", F.round("std", 6).alias("std"), "min", "max", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))




@query("""with a as (select l_suppkey % 20 as test, avg(l_quantity) filter (where l_returnflag = 'N') as b, stddev_samp(l_quantity) filter (where l_returnflag = 'N') as sb, count(*) filter (where l_returnflag = 'N') as nb,
avg(l_quantity) filter (where l_returnflag = 'R') as w, stddev_samp(l_quantity) filter (where l_returnflag = 'R') as sw, count(*) filter (where l_returnflag = 'R') as nw from lineitem group by 1),
d as (select *, (b - w) / sqrt(((nb - 1) * sb * sb + (nw - 1) * sw * sw) / (nb + nw - 2)) as d from a where nb > 0 and nw > 0)
select test, round(b, 6) as baseline_time, round(w, 6) as new_time, round(b / w, 6) as speedup, round((b - w) / b * 100, 6) as reduction_percent, round(d, 6) as cohens_d, case when abs(d) > 0.8 then 'large' when abs(d) > 0.5 then 'medium' when abs(d) > 0.2 then 'small' else 'negligible' end as effect from d""")
def speedup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("test", F.col("l_suppkey") % 20)
    out = V.speedups(rows, "test", "l_returnflag", "l_quantity", "N", "R")
    return out.select("test", *(F.round(c, 6).alias(c) for c in ("baseline_time", "new_time", "speedup", "reduction_percent", "cohens_d")), "effect")


@query()
def significance_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of mean quantities by supplier, so that a sample is a few dozen values."""
    each = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("test"), "l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return V.tests(each, "test", "l_returnflag", "v", "N", "R")


@query()
def mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mean_interval(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""select l_linestatus, l_returnflag, count(*) as runs, round(avg(l_quantity), 6) as mean, median(l_quantity) as median, round(stddev_samp(l_quantity), 6) as std, min(l_quantity) as min, max(l_quantity) as max from lineitem group by 1, 2""")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by index and complexity, as it were."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag")
    return rows.agg(F.count("*").alias("runs"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.expr("percentile(l_quantity, 0.5)").alias("median"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"))


@query("select l_suppkey % 10 as test, round(avg(l_quantity) filter (where l_returnflag = 'A'), 6) as a, round(avg(l_quantity) filter (where l_returnflag = 'N'), 6) as n, round(avg(l_quantity) filter (where l_returnflag = 'R'), 6) as r from lineitem group by 1")
def method_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("test")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_quantity"), 6))
    return rows.select("test", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("with m as (select l_suppkey % 20 as test, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as std from lineitem group by 1) select (select test from m order by mean, test limit 1) as fastest, (select test from m order by mean desc, test limit 1) as slowest, (select test from m order by std, test limit 1) as steadiest")
def best_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("test")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"))
    return each.agg(F.min_by("test", F.struct("mean", "test")).alias("fastest"), F.max_by("test", F.struct("mean", -F.col("test"))).alias("slowest"), F.min_by("test", F.struct("std", "test")).alias("steadiest"))


@query("with p as (select p_size as got, p_partkey % 60 as expected from part) select got, expected, count(*) as n, round(case when expected > 0 then least(1.0, cast(got as double) / expected) when got = 0 then 1.0 else 0.0 end, 6) as accuracy from p group by 1, 2")
def accuracy_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("got"), (F.col("p_partkey") % 60).alias("expected"))
    return rows.groupBy("got", "expected").agg(F.count("*").alias("n")).withColumn("accuracy", F.round(E.accuracy_proxy(F.col("got"), F.col("expected")), 6))


_EFFECT = "case when abs(d) > 0.8 then 'large' when abs(d) > 0.5 then 'medium' when abs(d) > 0.2 then 'small' else 'negligible' end"


@query(f"with p as (select (p_size - 25) / 20.0 as d from part) select {_EFFECT} as effect, count(*) as n from p group by 1")
def effect_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(V.effect_band((F.col("p_size") - 25) / 20).alias("effect")).agg(F.count("*").alias("n"))


@query("select event_type, round(avg(value), 6) as mean_latency, count(*) as queries, round(avg(case when user_id % 3 = 0 then 1.0 else 0.0 end), 6) as top_1 from events where value < 200 group by 1")
def search_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful queries by category: events stand for queries."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("latency"), (F.col("value") < 200).alias("success"), (F.col("user_id") % 3 == 0).alias("top_1"))
    return E.breakdown(rows, "event_type").select("event_type", F.round("mean_latency", 6).alias("mean_latency"), "queries", F.round("top_1", 6).alias("top_1"))


@query(f"""with {EL}, a as (select street, number, postcode, city, count(*) as n from el where street is not null and city is not null group by 1, 2, 3, 4), t as (select * from a order by n desc, street, number, postcode, city limit 20)
select 'exact' as category, 'easy' as difficulty, concat_ws(', ', street, number, city) as query, street as expected_street, city as expected_city from t union all select 'partial', 'medium', concat_ws(' ', street, city), street, city from t""")
def search_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases made of the 20 commonest addresses."""
    return search_test_cases(elements(spark, sf_dir), 20)


# --- pairs


@query(f"""with {PAIRS}, s as (select *, round(100 * (1 - cast(levenshtein(a, b) as double) / greatest(length(a), length(b))), 6) as score from pr),
r as (select *, row_number() over (partition by brand, a order by score desc, b) as k from s)
select brand, a as "left", b as "right", score from r where k = 1 and score >= 50 and score < 99""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.lower("p_name").alias("name"))
    return G.hard_negatives(rows, "brand", "name", lambda a, b: F.round(100 * S.levenshtein(a, b), 6), 50, 99)


@query("with b as (select distinct lower(p_name) as name, p_brand as brand from part), l as (select name, list_sort(list(brand)) as l from b group by name) select name, l[1] as block_1, l[2] as block_2 from l where len(l) > 1")
def cross_city_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.same_text_other_block(table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), F.col("p_brand").alias("brand")), "brand", "name")


@query()
def positive_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.positives(elements(spark, sf_dir).where("street is not null"), "id", "street", "number", "city", "postcode")


@query()
def balanced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled set of 200 pairs."""
    rows = elements(spark, sf_dir).where("street is not null")
    positive = G.positives(rows, "id", "street", "number", "city", "postcode")
    random = G.random_negatives(rows.withColumn("address", F.expr(ADDRESS)), "id", "address")
    first = lambda city, street: G.pair_order(F.xxhash64(city, street))
    hard = G.first_hard_negatives(rows, "city", "street", G.fuzzy_percent, 75, 99, 100, first).select(F.xxhash64("city", "left").alias("pair_id"), F.col("left").alias("address_1"), F.col("right").alias("address_2"), F.lit(0).alias("label"))
    return G.balanced(positive, hard, random, 100)


@query(f"with {EL}, t as (select id, {tokens(ADDRESS)} as t from el), d as (select id, list_distinct(t) as t from t where len(t) > 0) select x.id as id_1, y.id as id_2, round(cast(len(list_intersect(x.t, y.t)) as double) / len(list_distinct(list_concat(x.t, y.t))), 6) as similarity from d x join d y on x.id < y.id where cast(len(list_intersect(x.t, y.t)) as double) / len(list_distinct(list_concat(x.t, y.t))) >= 0.6")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).select("id", tokenize(F.expr(ADDRESS)).alias("t"))
    return G.jaccard_join(rows, "id", "t", 0.6).withColumn("similarity", F.round("similarity", 6))


@query("select label, cast(ceil(count(*) * 0.8) as bigint) as train, count(*) - cast(ceil(count(*) * 0.8) as bigint) as test from (select quality as label from labels) group by label")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.stratified_split(table(spark, sf_dir, "labels").withColumnRenamed("quality", "label"), "label", "doc_id")
    return rows.groupBy("label").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))


# --- features


def _feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).drop("levenshtein", "jaccard")


@query(f"""with {PAIRS}, q as (select brand, a, b, lower(trim(a)) as x, lower(trim(b)) as y from pr), s as (select brand, a, b, {_LEV} as phase2_levenshtein, {_BIGRAM} as phase2_jaccard, jaro_winkler_similarity(a, b) as phase2_jaro_winkler from q)
select brand, a, b, round(phase2_jaro_winkler, 6) as phase2_jaro_winkler, round(phase2_levenshtein, 6) as phase2_levenshtein, round(phase2_jaccard, 6) as phase2_jaccard, round((phase2_jaro_winkler + phase2_levenshtein + phase2_jaccard) / 3, 6) as phase2_average, round(0.5 * phase2_jaro_winkler + 0.3 * phase2_jaccard + 0.2 * phase2_levenshtein, 6) as phase2_weighted from s""")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.pair_scores(F.col("a"), F.col("b"))
    rows = X.combined(name_pairs(spark, sf_dir).select("brand", "a", "b", *(c.alias(f"phase2_{k}") for k, c in parts.items())))
    return rows.select("brand", "a", "b", *(F.round(c, 6).alias(c) for c in rows.columns if c.startswith("phase2_")))


@query(f"""with {PAIRS} select brand, a, b, length(a) as stat_length_1, length(b) as stat_length_2, abs(length(a) - length(b)) as stat_length_diff, round(cast(least(length(a), length(b)) as double) / greatest(length(a), length(b)), 6) as stat_length_ratio,
len(string_split(a, ' ')) as stat_words_1, len(string_split(b, ' ')) as stat_words_2, abs(len(string_split(a, ' ')) - len(string_split(b, ' '))) as stat_words_diff, length(regexp_replace(a, '[^0-9]', '', 'g')) as stat_digits_1, length(regexp_replace(b, '[^0-9]', '', 'g')) as stat_digits_2,
case when length(regexp_replace(a, '[^0-9]', '', 'g')) = length(regexp_replace(b, '[^0-9]', '', 'g')) then 1 else 0 end as stat_digits_equal from pr""")
def statistical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = name_pairs(spark, sf_dir).select("brand", "a", "b", *(c.alias(k) for k, c in X.statistics(F.col("a"), F.col("b")).items()))
    return rows.select("brand", "a", "b", *(F.round(c, 6).alias(c) if c == "stat_length_ratio" else F.col(c).cast("long").alias(c) for c in rows.columns[3:]))




@query(f"""with {PAIRS}, {_TOK}, z as (select brand, a, b, {_LEV} as t, {_JAC} as c, 0.0 as e from tk) select brand, a, b, round(t * c, 6) as interact_text_component, cast(0 as double) as interact_text_entity,
cast(case when round(t, 9) > 0.7 then 1 else 0 end + case when round(c, 9) > 0.7 then 1 else 0 end as bigint) as n_high, round((power(t - (t + c) / 3, 2) + power(c - (t + c) / 3, 2) + power((t + c) / 3, 2)) / 2, 6) as interact_variance, round((t + c) / 3, 6) as interact_mean from z""")
def interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    out = X.interactions(F.round("levenshtein", 9), F.round("jaccard", 9), F.lit(0.0))
    n = out["interact_text_high"] + out["interact_component_high"] + out["interact_entity_high"]
    return rows.select("brand", "a", "b", *(F.round(out[k], 6).alias(k) for k in ("interact_text_component", "interact_text_entity")), n.cast("long").alias("n_high"), *(F.round(out[k], 6).alias(k) for k in ("interact_variance", "interact_mean")))


@query()
def component_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.parsing import parse

    pairs = G.positives(elements(spark, sf_dir).where("street is not null"), "id", "street", "number", "city", "postcode")
    rows = pairs.withColumn("l", parse(F.col("address_1"))).withColumn("r", parse(F.col("address_2")))
    return rows.select("pair_id", *(c.alias(k) for k, c in X.component_scores(lambda c: F.col("l")[c], lambda c: F.col("r")[c]).items()))


_ENT = "list_distinct(list_transform(regexp_extract_all(text, '([A-ZÉÈÀÁÍÓÚÑÜÄÖÇÊ][a-zA-ZéèàáíóúñüäöçêßÉÈÀÁÍÓÚÑÜÄÖÇÊ''-]+(?: (?:d[aeo]s? )?[A-ZÉÈÀÁÍÓÚÑÜÄÖÇÊ][a-zA-ZéèàáíóúñüäöçêßÉÈÀÁÍÓÚÑÜÄÖÇÊ''-]+)*)'), lambda e: lower(e)))"


@query(f"select doc_id, len({_ENT}) as n_entities from documents")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.entities(F.col("text"))).cast("long").alias("n_entities"))


@query()
def entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = name_pairs(spark, sf_dir).select("brand", "a", "b", X.entities(F.initcap("a")).alias("x"), X.entities(F.initcap("b")).alias("y"))
    return rows.select("brand", "a", "b", *(c.alias(k) for k, c in X.entity_features(F.col("x"), F.col("y")).items()))


@query(f"with {PAIRS}, {_TOK}, {_SCORES} select 'levenshtein' as feature, round(avg(levenshtein), 6) as mean, round(stddev_samp(levenshtein), 6) as std, count(*) filter (where levenshtein <> 0) as non_zero from sc union all select 'jaccard', round(avg(jaccard), 6), round(stddev_samp(jaccard), 6), count(*) filter (where jaccard <> 0) from sc")
def feature_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.describe(scores(spark, sf_dir), ["levenshtein", "jaccard"]).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "non_zero")


@query(f"with {PAIRS}, {_TOK}, {_SCORES} select count(*) filter (where jaccard > 0.5) as high, count(*) filter (where jaccard >= 0.2 and jaccard <= 0.5) as medium, count(*) filter (where jaccard < 0.2) as low from sc")
def similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bands(scores(spark, sf_dir), "jaccard")
