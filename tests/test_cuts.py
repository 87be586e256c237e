"""Results that a cut would change: long chains, many sizes, one-word names, a label with most rows."""

import random

from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.operators import cities, pairs, statistics


def test_a_long_chain_of_names_is_one_group(spark):
    chain = [(f"n{k:03}", f"n{k + 1:03}") for k in range(150)]
    random.Random(1).shuffle(chain)
    found = cities.name_groups(spark.createDataFrame([*chain, ("x", "y"), ("y", "z")], "name string, similar string"))
    assert {(r.name, r.group) for r in found.collect()} == {(f"n{k:03}", "n000") for k in range(151)} | {(n, "x") for n in "xyz"}
    assert cities.name_groups(spark.createDataFrame([], "name string, similar string")).count() == 0


def test_intervals_of_all_sizes(spark):
    rows = [(n, float(k)) for n in (2, 3, 40, 500) for k in range(n)]
    found = {r.g: r for r in statistics.mean_interval(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    assert abs((found[2].high - found[2].low) / 2 - 12.706205 * 0.707107 / 2**0.5) < 1e-3
    assert abs((found[3].high - found[3].low) / 2 - 4.302653 / 3**0.5) < 1e-3 and set(found) == {2, 3, 40, 500}


def test_hard_negatives_are_the_best_of_all_others(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 4)
    rng = random.Random(4)
    rows = [(rng.choice("pqr"), "".join(rng.choice("abc") for _ in range(rng.randint(3, 7)))) for _ in range(90)] + [("s", "alone"), ("p", None), ("t", "liberdade"), ("t", "liberdades")]

    def score(a, b):
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, table[0] = table[0], i
            for j, y in enumerate(b, 1):
                last, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, last + (x != y))
        return 100 * (1 - table[-1] / max(len(a), len(b)))

    want = set()
    for block in "pqrst":
        texts = sorted({t for b, t in rows if b == block and t})
        for a in texts:
            best = min(((-score(a, b), b) for b in texts if b != a), default=None)
            if best and 50 <= -best[0] < 85:
                want.add((block, a, best[1]))
    frame = spark.createDataFrame(rows, "block string, name string")
    levenshtein = lambda a, b: 100 * S.levenshtein(a, b)
    for by_row in (False, True):
        found = pairs.hard_negatives(frame, "block", "name", levenshtein, 50, 85, by_row=by_row)
        assert {(r.block, r.left, r.right) for r in found.collect()} == want


def test_a_split_has_its_share_of_each_label(spark):
    rows = spark.range(1003).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    split = pairs.stratified_split(rows, "label", "id")
    assert {(r.label, r.train): r["count"] for r in split.groupBy("label", "train").count().collect()} == {(0, True): 722, (0, False): 180, (1, True): 81, (1, False): 20}
    again = pairs.stratified_split(rows.repartition(7), "label", "id")
    assert sorted(split.collect()) == sorted(again.collect())


def test_first_hard_negatives_are_the_first_of_all(spark, monkeypatch):
    """Those asked for at once, in several steps, and all; of the others no scores are made."""
    monkeypatch.setattr(pairs, "CHUNK", 4)
    monkeypatch.setattr(pairs, "AHEAD", 1)
    rng = random.Random(9)
    rows = [(rng.choice("pqr"), "".join(rng.choice("abc") for _ in range(rng.randint(3, 7)))) for _ in range(90)] + [("s", "alone"), ("p", None)]
    frame = spark.createDataFrame(rows, "block string, name string")
    pair = F.xxhash64("block", "left")
    every = pairs.hard_negatives(frame, "block", "name", pairs.fuzzy_percent, 50, 95, by_row=True).orderBy(*pairs.pair_order(pair)).collect()
    asked, best = [], pairs._best_others
    monkeypatch.setattr(pairs, "_best_others", lambda texts, *rest: (asked.append(texts.count()), best(texts, *rest))[1])
    order = lambda block, a: pairs.pair_order(F.xxhash64(block, a))
    for n in (1, 5, 20, 1000):
        asked.clear()
        found = pairs.first_hard_negatives(frame, "block", "name", pairs.fuzzy_percent, 50, 95, n, order).orderBy(*pairs.pair_order(pair)).collect()
        assert found[:n] == every[:n] and len(found) >= min(n, len(every)) and len(every) > 20
        assert n == 1000 or asked[0] == n
    assert sum(asked) == len({r for r in rows if r[1] and r[0] != "s"})
    assert pairs.first_hard_negatives(frame.where("block = 's'"), "block", "name", pairs.fuzzy_percent, 50, 95, 3, order).count() == 0
