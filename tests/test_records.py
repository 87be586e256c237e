"""Stems, saved models, tables in the catalog."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.stemming import stem
from tessera.operators import lexicon, search
from tessera.operators import learning as L
from tessera.sources import tables

# Words of the algorithm's published vocabulary.
STEMS = "boas boas, boataria boat, boate boat, boatos boat, boba bob, bobagem bobag, bobalhões bobalhõ, bobear bob, bobeira bobeir, bobinhos bobinh, bocado boc, bocaiúva bocaiúv, boçal boçal, quilométricas quilométr, quilombo quilomb, quimera quim, químico químic, quinhão quinhã, quiseram quis, quiosques quiosqu, amente ament, ç c"


@pytest.mark.parametrize("pair", STEMS.split(", "))
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_short_and_odd_words_have_stems():
    for w in ("", "a", "é", "ai", "xyz", "123", "rua", "ções", "ções" * 50):
        assert isinstance(stem(w), str) and len(stem(w)) <= len(w) + 1


def test_postings_of_stems(spark):
    docs = spark.createDataFrame([(1, "boato boatos e a boba"), (2, "bobo")], "id long, t string")
    found = {(r.term, r.id): (r.tf, list(r.positions), r.dl) for r in search.postings(docs, "id", ["t"], stems=True).collect()}
    assert found == {("boat", 1): (2, [0, 1], 3), ("bob", 1): (1, [2], 3), ("bob", 2): (1, [0], 1)}


def test_code_sets(spark):
    rows = spark.createDataFrame([(1, ["silva", "rua"]), (2, ["cilva"]), (3, []), (4, None)], "id long, w array<string>")
    assert {r.id: r.codes for r in lexicon.code_sets(rows, "id", "w", "metaphone").collect()} == {1: ["R", "SLF"], 2: ["SLF"]}


def test_models_saved_and_loaded(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 2).alias("label"), (F.col("id") % 2 + F.rand(1) / 4).alias("x"), F.rand(2).alias("y"), (F.col("id") % 5 != 0).alias("train"))
    data = L.numeric(rows, ["x", "y"])
    names = ["logistic_regression", "random_forest"]
    models = {n: m for n, (m, _) in L.train(data, ["x", "y"], names).items()}
    L.save(models, str(tmp_path))
    L.save(models, str(tmp_path))  # again, over what is there
    again = L.load(str(tmp_path), names)
    for n in names:
        assert [r.prediction for r in again[n].transform(data).collect()] == [r.prediction for r in models[n].transform(data).collect()]


def test_exists(spark):
    spark.range(1).createOrReplaceTempView("a_view")
    assert tables.exists(spark, "a_view") and not tables.exists(spark, "no_such_view")
