"""Unit vectors of normalization and parsing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.functions import text as T


def values(spark, function, rows):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, c string")
    return [r.v for r in frame.select("k", function(F.col("c")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (T.preprocess, {"R. ANTÓNIO  JOSÉ, de Almeida": "r. antonio jose de almeida", "Rua Doutor Manuel D'Arriaga": "rua doutor manuel darriaga", "Câmara de Lobos - Ilha": "camara de lobos - ilha", "": "", "a  b": "a b"}),
        (T.normalize_street, {"R. ANTÓNIO JOSÉ DE ALMEIDA": "rua antonio jose almeida", "Av. da Liberdade": "avenida liberdade", "St Maria": "sitio maria", "Pr. do Comércio": "pr. comercio", "": ""}),
        (T.normalize_postcode, {"1000123": "1000-123", "1100-048": "1100-048", "PT-1000-001": "1000-001", "6200": None, "": None}),
        (T.normalize_query, {"R. da Liberdade": "rua liberdade", "Centro Comercial Colombo, Lisboa": "centro comercial colombo lisboa", "a e o": "", " ": ""}),
        (T.normalize_phonetic, {"travessa": "travesa", "guarda": "garda", "chaves": "xaves", "aquário": "akario", "ilha": "ilya", "minho": "minyo"}),
        (lambda c: F.array_join(T.tokenize(c), " "), {"R. Augusta, 100, Lisboa": "rua augusta 100 lisboa", "Praça do Comércio": "praca comercio", "Pc. do Comércio": "praça comercio"}),
        (T.title, {"corte do pinto": "Corte Do Pinto", "da-madeira": "Da-Madeira"}),
    ],
)
def test_vectors(spark, function, pairs):
    assert values(spark, function, list(pairs)) == list(pairs.values())


def test_housenumbers(spark):
    rows = ["123A", "120/122", "22,24,26", "10 A", "Lote 5", "s/n", None]
    found = [None if v is None else tuple(v) for v in values(spark, T.normalize_housenumber, rows)]
    assert found == [(123, "a"), (120, "122"), (22, "2426"), (10, "a"), (5, None), None, None]


def test_sane_housenumbers(spark):
    frame = spark.createDataFrame([(0,), (1,), (999999,), (1000000,), (None,)], "n long")
    assert [r.v for r in frame.select(T.sane_housenumber(F.col("n")).alias("v")).collect()] == [None, 1, 999999, None, None]


def test_parse(spark):
    rows = {
        "Rua Zeca Afonso, 5, 7750-102, Corte do Pinto": ("rua zeca afonso", "5", "Corte Do Pinto", "7750-102"),
        "Rua Doutor Manuel D'Arriaga, 32, 7480-139, Avis": ("rua doutor manuel darriaga", "32", "", "7480-139"),
        "Rua 5 De Outubro, 28, 9000-079": ("rua 5 outubro", "28", "", "9000-079"),
        "Rua 25 de Abril, 2, Porto": ("rua 5 abril", "2", "Porto", ""),
    }
    found = [(v.road, v.house_number, v.city, v.postcode) for v in values(spark, parsing.parse, list(rows))]
    assert found == list(rows.values())
    corrected = values(spark, lambda c: parsing.parse(c, compat=False), ["Rua X, 32, 7480-139, Avis", "Rua X, 32, Av. Y"])
    assert [v.city for v in corrected] == ["Avis", ""]


def test_nulls(spark):
    for f in (T.preprocess, T.normalize_street, T.normalize_characters, T.normalize_tokens, T.normalize_phonetic):
        assert values(spark, f, [None]) == [""]
    assert values(spark, T.normalize_postcode, [None]) == [None]
    assert values(spark, parsing.parse, [None])[0].road == ""


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x17F), max_size=30), min_size=1, max_size=40))
def test_preprocess_is_idempotent(spark, rows):
    once = values(spark, T.preprocess, rows)
    assert values(spark, T.preprocess, once) == once


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="0123456789- x", max_size=12), min_size=1, max_size=40))
def test_postcode_is_idempotent(spark, rows):
    once = values(spark, T.normalize_postcode, rows)
    assert values(spark, T.normalize_postcode, once) == once
