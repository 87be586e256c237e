"""Unit vectors of evaluation, statistics, space, profiles, pairs, sources."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.functions import spatial as Z
from tessera.operators import addresses, cities, evaluate, pairs, profile, search
from tessera.operators import statistics as V
from tessera.sources import tables


def test_confusion(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "label int, score double")
    r = evaluate.evaluate(rows, 0.5).first()
    assert (r.true_positives, r.false_positives, r.false_negatives, r.true_negatives) == (1, 1, 1, 1)
    assert (r.precision, r.recall, r.f1_score, r.accuracy) == (0.5, 0.5, 0.5, 0.5)
    assert r.similarity_separation == pytest.approx(0.3)
    empty = evaluate.evaluate(rows.limit(0), 0.5).first()
    assert (empty.precision, empty.f1_score, empty.accuracy) == (0.0, 0.0, 0.0)


def test_sweep_invariants(spark):
    rows = spark.createDataFrame([("x", k % 2, (k * 37 % 101) / 101) for k in range(100)], "algorithm string, label int, score double")
    found = evaluate.threshold_sweep(rows).orderBy("threshold").collect()
    assert len(found) == 18
    assert {r.true_positives + r.false_negatives for r in found} == {50}
    assert all(a.recall >= b.recall for a, b in zip(found, found[1:]))


def test_weight_vectors():
    assert len(evaluate.weight_vectors(2)) == 9
    assert evaluate.weight_vectors(3) == [(0.2, 0.2, 0.6), (0.2, 0.4, 0.4), (0.2, 0.6, 0.2), (0.4, 0.2, 0.4), (0.4, 0.4, 0.2), (0.6, 0.2, 0.2)]


def test_graded_match(spark):
    grade, match = evaluate.graded_match({"street": F.lit(1.0), "city": F.lit(0.2), "postcode": F.lit(0.0)}, {"street": F.lit("a"), "city": F.lit("b"), "postcode": F.lit(None)})
    none, no = evaluate.graded_match({"street": F.lit(1.0)}, {"street": F.lit("")})
    r = spark.range(1).select(grade.alias("g"), match.alias("m"), none.alias("n"), no.alias("o")).first()
    assert r.g == pytest.approx(0.670588, abs=1e-6) and r.m and r.n == 0.0 and not r.o


def test_confidence(spark):
    r = spark.range(1).select(search.confidence(F.lit(10.0), F.lit(0.75)).alias("a"), search.confidence(F.lit(10.0), F.lit(0.0)).alias("b")).first()
    assert (r.a, r.b) == pytest.approx((7.225, 7.15))


def test_histogram(spark):
    rows = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,), (None,)], "c double")
    assert [r.b for r in rows.select(profile.completeness_histogram(F.col("c")).alias("b")).collect()] == [None, 1, 2, 4, None]


@pytest.mark.parametrize("n", [2, 3, 20, 101])
def test_exclusive_quantile(spark, n):
    values = [float(k * 7 % n) for k in range(n)]
    found = spark.createDataFrame([(values,)], "v array<double>").select(V.exclusive_quantile(F.col("v"), 0.95).alias("q")).first().q
    assert found == pytest.approx(statistics.quantiles(values, n=100, method="exclusive")[94])


def test_effect_size(spark):
    rows = spark.createDataFrame([("t", "base", float(x)) for x in (10, 12, 14)] + [("t", "new", float(x)) for x in (5, 6, 7)], "k string, arm string, v double")
    r = V.speedups(rows, "k", "arm", "v", "base", "new").first()
    assert (r.speedup, r.reduction_percent, r.cohens_d) == pytest.approx((2.0, 50.0, 3.794733), abs=1e-6)
    assert r.effect == "large"
    t = V.tests(rows, "k", "arm", "v", "base", "new").first()
    assert t.u == 9 and t.p_greater == pytest.approx(0.05) and t.p_welch < 0.05


def test_student():
    assert V.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert V.t_tail(2.0, 5) == pytest.approx(0.101939, abs=1e-5)


def test_distance(spark):
    metres = spark.range(1).select(Z.haversine(*Z.LISBON, *Z.PORTO).alias("m")).first().m
    assert metres == pytest.approx(274295.885, abs=0.01)


def test_box_edges_are_outside(spark):
    rows = spark.createDataFrame([(-9.3, 38.7), (-9.1, 38.7)], "lon double, lat double")
    assert rows.where(Z.within_box(F.col("lon"), F.col("lat"), Z.BOXES["lisbon"])).count() == 1


def test_radius_is_the_plain_test(spark):
    rows = spark.range(2000).select((F.col("id") % 50 / 10 - 11).alias("lon"), (F.col("id") / 50 / 10 + 36).alias("lat"))
    for metres in (1000, 100_000, 500_000):
        plain = rows.where(Z.haversine(F.col("lon"), F.col("lat"), *Z.LISBON) <= metres).count()
        assert rows.where(Z.within_radius(F.col("lon"), F.col("lat"), Z.LISBON, metres)).count() == plain


def test_tags(spark):
    rows = spark.createDataFrame([("{'addr:street': 'Rua d''Ouro', 'building': 'yes', 'building': 'no'}",), ("{}",), (None,)], "t string")
    found = [r.m for r in rows.select(profile.parse_tags(F.col("t")).alias("m")).collect()]
    assert found == [{"addr:street": "Rua d'Ouro", "building": "no"}, {}, {}]


def test_record(spark):
    rows = spark.createDataFrame([({"addr:street": "R. ANTÓNIO JOSÉ DE ALMEIDA", "addr:housenumber": "123A", "addr:postcode": "1000123", "addr:city": "Lisboa"},), ({"building": "yes"},)], "tags map<string,string>")
    r = addresses.normalize(addresses.extract(rows)).collect()
    assert len(r) == 1
    assert (r[0].street_clean, r[0].housenumber_primary, r[0].housenumber_specifier, r[0].postcode_clean, r[0].city_clean) == ("rua antonio jose almeida", 123, "a", "1000-123", None)
    assert (r[0].original_completeness, r[0].improved_completeness) == (1.0, 0.75)


def test_city_repair(spark):
    rows = spark.createDataFrame([(1, "LISBOA"), (2, "Lisbona"), (3, "Xyz"), (4, None)], "k int, city string")
    found = cities.repair(rows, "city", spark.createDataFrame([("Lisboa",), ("Porto",)], "name string"))
    assert {r.k: r.city_clean for r in found.collect()} == {1: "lisboa", 2: "lisboa", 3: None, 4: None}


def test_name_groups(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "name string, similar string")
    assert {r.name: r.group for r in cities.name_groups(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_pairs_are_seeded(spark, data):
    rows = spark.range(200).select(F.col("id"), F.concat(F.lit("Rua do Ouro "), F.col("id").cast("string")).alias("s"), F.lit("1").alias("n"), F.lit("Lisboa").alias("c"), F.lit("1000-001").alias("p"))
    one = pairs.positives(rows, "id", "s", "n", "c", "p").collect()
    assert sorted(one) == sorted(pairs.positives(rows.repartition(7), "id", "s", "n", "c", "p").collect())
    assert all(r.address_1 != r.address_2 for r in one) and len(one) > 150


def test_split_is_exact(spark):
    rows = spark.range(103).select(F.col("id"), (F.col("id") % 3).alias("label"))
    found = pairs.stratified_split(rows, "label", "id").groupBy("label").agg(F.count_if("train").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t == -(-r.n * 8 // 10) for r in found)


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, 'a, "b"\nc'), (2, None)], "k int, s string")
    tables.write_csv(frame, path)
    assert sorted(tables.read_csv(spark, path, "k int, s string").collect()) == sorted(frame.collect())
    assert not tables.is_ready(spark, str(tmp_path / "none"))
    tables.write_table(frame, path + "p")
    tables.write_table(frame, path + "p")
    assert tables.is_ready(spark, path + "p") and spark.read.parquet(path + "p").count() == 2
    assert tables.matches_schema(spark, path + "p", frame.schema) and not tables.matches_schema(spark, path + "p", spark.range(1).schema)
    (tmp_path / "places.csv").write_bytes("x\ny\n1,Évora\n2,Lisboa\n".encode("latin-1"))
    assert [r.name for r in tables.read_places(spark, str(tmp_path / "places.csv")).collect()] == ["Évora", "Lisboa"]
    assert r"\caption{x}" in tables.latex(frame.select("k"), "x") and tables.markdown(frame).startswith("| k | s |")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, a string, b string, lon double, lat double")
    assert profile.value_counts(none, "a").count() == 0
    assert profile.grid_density(none).count() == 0
    assert pairs.jaccard_join(none.select("k", F.split("a", " ").alias("t")), "k", "t", 0.5).count() == 0
    assert search.postings(none, "k", ["a"]).count() == 0


def test_jaccard_join_of_copies(spark):
    base = ["a b c d e", "e d c b a a", "a b c d x", "q", "a b", "z y w v u"]
    sets = [(k, base[k * 7 % 6].split()) for k in range(60)]
    joined = pairs.jaccard_join(spark.createDataFrame(sets, "k long, t array<string>"), "k", "t", 0.6)
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert sorted(map(tuple, joined.collect())) == [(j, k, share(a, b)) for j, a in sets for k, b in sets if j < k and share(a, b) >= 0.6]
    assert "Aggregate [s#" in joined._jdf.queryExecution().optimizedPlan().toString()  # sets are verified once, whatever their copies


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 0.9])
def test_jaccard_join_of_sets_of_all_sizes(spark, least):
    """Sets that meet by one token and by two, and some of each size with the next."""
    rng = random.Random(8)
    sets = [(k, list({rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((1, 2, 3, 5, 9, 14, 40)))})) for k in range(150)]
    big = [f"w{k}" for k in range(40)]
    sets += [(200 + k, big[:size]) for k, size in enumerate(range(9, 40))]
    joined = pairs.jaccard_join(spark.createDataFrame(sets, "k long, t array<string>"), "k", "t", least)
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert sorted(map(tuple, joined.collect())) == [(j, k, share(a, b)) for j, a in sets for k, b in sets if j < k and share(a, b) >= least]


def test_jaccard_join_meets_few_sets_that_share_one_token(spark, monkeypatch):
    """Sets of six by two common tokens of 20 and four rare ones: one token of a prefix brings very many together, two few."""
    sets = [(k, [f"n{k % 20}", f"p{k // 20}", f"q{k * 7 % 19}", *(f"c{k * j % 3 + j * 10}" for j in (1, 2, 3))]) for k in range(400)]
    met, meetings = [], pairs._meetings
    monkeypatch.setattr(pairs, "_meetings", lambda *x: met.append(meetings(*x)) or met[-1])
    found = pairs.jaccard_join(spark.createDataFrame(sets, "k long, t array<string>"), "k", "t", 0.6)
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert found.count() == sum(share(a, b) >= 0.6 for j, a in sets for k, b in sets if j < k)
    one = sum(len({*a[:3]} & {*b[:3]}) for j, a in sets for k, b in sets if j < k)
    assert met[0].count() < one
