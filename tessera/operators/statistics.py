"""Timings compared: exclusive quantiles, speedups, effect sizes, tests. Samples are grouped rows; a test's p-value needs both samples at once."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = (("large", 0.8), ("medium", 0.5), ("small", 0.2))


def exclusive_quantile(values: Column, p: float) -> Column:
    """Of an array without nulls, at place p (n + 1), linear between neighbours and beyond the ends as between the last two; null below two values."""
    x, n = F.array_sort(values), F.size(values)
    place = F.lit(p) * (n + 1)
    low = F.least(F.greatest(F.floor(place), F.lit(1)), n - 1).cast("int")
    a, b = F.get(x, low - 1), F.get(x, low)
    return F.when(n >= 2, a + (b - a) * (place - low))


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, deviation (0 for one), ends, p95 and p99; the maximum stands in below 20 and 100 values.

    The quantiles are exclusive ones, read off the counts of different values up to each of them, so no group is held in memory.
    """
    known = samples.where(F.col(value).isNotNull())
    each = known.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    counts = known.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("_c").over(group.orderBy("_v"))).withColumn("_n", F.sum("_c").over(group))

    def at(p: float, name: str) -> list[Column]:
        place = F.lit(p) * (F.col("_n") + 1)
        low = F.least(F.greatest(F.floor(place), F.lit(1)), F.col("_n") - 1)
        value_of = lambda r: F.min(F.when(F.col("_upto") >= r, F.col("_v")))
        a, b = value_of(low), value_of(low + 1)
        return [F.when(F.first("_n") >= 2, a + (b - a) * F.first(place - low)).alias(name)]

    quantiles = ranked.groupBy(*by).agg(*at(0.95, "_p95"), *at(0.99, "_p99")).select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), "_p95", "_p99")
    same = [each[c].eqNullSafe(quantiles[f"_by{k}"]) for k, c in enumerate(by)]
    pick = lambda name, least: F.when(F.col("n") < least, F.col("max")).otherwise(F.col(name))
    return each.join(quantiles, same).select(*by, "n", "mean", "median", "std", "min", "max", pick("_p95", 20).alias("p95"), pick("_p99", 100).alias("p99"))


def cohens_d(mean_a: Column, std_a: Column, n_a: Column, mean_b: Column, std_b: Column, n_b: Column) -> Column:
    pooled = F.sqrt(((n_a - 1) * F.pow(std_a, F.lit(2)) + (n_b - 1) * F.pow(std_b, F.lit(2))) / (n_a + n_b - 2))
    return F.when((n_a + n_b > 2) & (pooled > 0), (mean_a - mean_b) / pooled).otherwise(0.0)


def effect_band(d: Column) -> Column:
    out = F.lit("negligible")
    for name, least in reversed(BANDS):
        out = F.when(F.abs(d) > least, name).otherwise(out)
    return out


def speedups(samples: DataFrame, key: str, arm: str, value: str, base: str, other: str) -> DataFrame:
    """Per key: mean of both arms, base / other, percent saved, effect size; one aggregation, no join."""
    of = lambda f, a: f(F.when(F.col(arm) == a, F.col(value)))
    each = samples.groupBy(key).agg(*(of(f, a).alias(f"{n}_{s}") for s, a in (("base", base), ("new", other)) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))))
    b, w = F.col("mean_base"), F.col("mean_new")
    d = cohens_d(b, F.coalesce("std_base", F.lit(0.0)), F.col("n_base"), w, F.coalesce("std_new", F.lit(0.0)), F.col("n_new"))
    return each.where("n_base > 0 and n_new > 0").select(key, b.alias("baseline_time"), w.alias("new_time"), F.when(w > 0, b / w).alias("speedup"), ((b - w) / F.nullif(b, F.lit(0.0)) * 100).alias("reduction_percent"), d.alias("cohens_d"), effect_band(d).alias("effect"))


def interval(mean: Column, std: Column, n: Column, z: float = 1.96) -> Column:
    """A normal confidence interval."""
    half = z * std / F.sqrt(n)
    return F.struct((mean - half).alias("low"), (mean + half).alias("high"))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def mann_whitney(a: list[float], b: list[float], two_sided: bool = False) -> tuple[float, float]:
    """U of the first sample, and the p-value that it is greater: exact without ties below 21 values, else by the normal limit."""
    n, m = len(a), len(b)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    both = sorted([*a, *b])
    if len(set(both)) == n + m and n + m <= 20:
        counts = {(0, 0): [1]}

        def ways(i: int, j: int) -> list[int]:
            if (i, j) not in counts:
                out = [0] * (i * j + 1)
                if i:
                    for k, w in enumerate(ways(i - 1, j)):
                        out[k + j] += w
                if j:
                    for k, w in enumerate(ways(i, j - 1)):
                        out[k] += w
                counts[i, j] = out
            return counts[i, j]

        all_ = ways(n, m)
        upper = sum(all_[math.ceil(u) :]) / sum(all_)
        lower = sum(all_[: math.floor(u) + 1]) / sum(all_)
    else:
        ties = sum(c**3 - c for c in pd.Series(both).value_counts())
        size = n + m
        spread = math.sqrt(n * m / 12 * (size + 1 - ties / (size * (size - 1)))) if size > 1 else 0.0
        upper = normal_tail((u - n * m / 2 - 0.5) / spread) if spread else 1.0
        lower = normal_tail((n * m / 2 - u - 0.5) / spread) if spread else 1.0
    return u, min(1.0, 2 * min(upper, lower)) if two_sided else upper


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by the continued fraction of Lentz."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(300):
        m = k // 2
        if k == 0:
            step = 1.0
        elif k % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + step * d or 1e-30)
        c = 1 + step / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def t_tail(t: float, degrees: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(degrees / 2, 0.5, degrees / (degrees + t * t))


def t_quantile(p: float, degrees: float) -> float:
    low, high = 0.0, 1e4
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, degrees) > 2 * (1 - p) else (low, middle)
    return low


def welch(a: list[float], b: list[float]) -> tuple[float, float]:
    """t and two-sided p."""
    x, y = pd.Series(a, dtype=float), pd.Series(b, dtype=float)
    va, vb = x.var() / len(x), y.var() / len(y)
    if not va + vb > 0:
        return 0.0, 1.0
    t = (x.mean() - y.mean()) / math.sqrt(va + vb)
    return t, t_tail(t, (va + vb) ** 2 / (va**2 / (len(x) - 1) + vb**2 / (len(y) - 1)))


def tests(samples: DataFrame, key: str, arm: str, value: str, base: str, other: str) -> DataFrame:
    """Per key: Mann-Whitney (one- and two-sided) and Welch of two arms. Samples of one key must fit a task: they are benchmark runs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows.loc[rows[arm] == x, value].dropna().tolist() for x in (base, other))
        if len(a) < 2 or len(b) < 2:
            return pd.DataFrame({key: rows[key].iloc[:1], "u": [None], "p_greater": [None], "p_two_sided": [None], "t": [None], "p_welch": [None]})
        u, greater = mann_whitney(a, b)
        t, p = welch(a, b)
        return pd.DataFrame({key: rows[key].iloc[:1].tolist(), "u": [u], "p_greater": [greater], "p_two_sided": [mann_whitney(a, b, True)[1]], "t": [t], "p_welch": [p]})

    kind = samples.schema[key].dataType.simpleString()
    return samples.select(key, arm, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(run, f"{key} {kind}, u double, p_greater double, p_two_sided double, t double, p_welch double")


def mean_interval(samples: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Student's interval of the mean. A quantile is found once for each size that groups have, on the executors."""
    each = samples.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")).where("n > 1")

    def found(batches):
        for rows in batches:
            yield pd.DataFrame({"n": rows["n"], "q": [t_quantile((1 + level) / 2, int(n) - 1) for n in rows["n"]]})

    quantiles = each.select("n").distinct().mapInPandas(found, "n long, q double")
    half = F.col("q") * F.col("std") / F.sqrt("n")
    return each.join(quantiles, "n").select(*by, "mean", "n", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def running_mean(samples: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``samples`` with ``runs`` and ``running_mean``: of each series, how many and their mean so far."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.withColumn("runs", F.count(value).over(so_far)).withColumn("running_mean", F.avg(value).over(so_far))


def built_speedups(builds: DataFrame, speedups: DataFrame, key: str) -> DataFrame:
    """What each index cost to build beside the mean speedup of its tests."""
    each = speedups.groupBy(key).agg(F.avg("speedup").alias("mean_speedup"), F.count("*").alias("tests"))
    return builds.join(each, key)
