"""Unit vectors and invariants of similarities."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import codes
from tessera.functions import similarity as S
from tessera.operators import tfidf


def scores(spark, name, pairs):
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return [r.v for r in frame.select("k", S.score(name, F.col("a"), F.col("b")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("name", "a", "b", "want"),
    [
        ("levenshtein", "kitten", "sitting", 0.571429), ("levenshtein", "", "", 1.0), ("levenshtein", "", "x", 0.0),
        ("jaro", "martha", "marhta", 0.944444), ("jaro_winkler", "martha", "marhta", 0.961111), ("jaro", "abcdef", "bcadef", 0.916667),
        ("jaccard", "Rua Augusta Lisboa", "Rua Augusta Porto", 0.5), ("jaccard", "", "de", 1.0), ("tfidf", "rua augusta", "rua prata", 0.201993),
        ("soundex", "Rua das Flores, 123, Lisboa", "Rua das Flôres, 123, Lisboa", 1.0), ("soundex", "Rua Silva", "Rua Cilva", 0.0), ("soundex", "", "", 0.0),
        ("bigram", "abc", "abd", 0.333333), ("bigram", None, "abd", 0.0), ("exact", " A ", "a", 1.0),
    ],
)
def test_vectors(spark, name, a, b, want):
    assert scores(spark, name, [(a, b)])[0] == pytest.approx(want, abs=1e-6)


def test_floored_jaro():
    assert codes.jaro("abcdef", "bcadef", floored=True) == pytest.approx(0.944444, abs=1e-6)


@pytest.mark.parametrize("name", sorted(S.SIMILARITIES))
def test_range_symmetry_identity(spark, name):
    texts = ["Rua das Flores, 12, Porto", "R. Flores 12 Porto", "Avenida da Liberdade", "Lisboa", "x", "Travessa dos Clérigos"]
    pairs = [(a, b) for a in texts for b in texts]
    found = dict(zip(pairs, scores(spark, name, pairs), strict=True))
    assert all(0 <= v <= 1 + 1e-12 for v in found.values())
    if name != "sequence":  # its blocks depend on the order
        assert all(found[a, b] == pytest.approx(found[b, a]) for a, b in pairs)
    assert found["Avenida da Liberdade", "Avenida da Liberdade"] == pytest.approx(1.0)


def test_graded(spark):
    rows = spark.createDataFrame([(96.0,), (90.0,), (78.0,), (65.0,), (59.0,)], "p double")
    found = [r.v for r in rows.select(S.graded(F.col("p"), "street").alias("v")).collect()]
    assert found == pytest.approx([1.0, 0.85, 0.56, 0.25, 0.0])


def test_codes():
    assert codes.metaphone("Thompson") == "0MPSN" and codes.metaphone("knight") == codes.metaphone("night") == "NT"
    assert codes.nysiis("MACINTOSH") == "MCANT" and codes.nysiis("KNUTH") == "NAT"
    assert codes.metaphone("") == codes.nysiis("") == codes.double_metaphone("") == ""


def test_ratios():
    assert codes.ratio("abc", "abc") == 100 and codes.ratio("abc", "xyz") == 0 and codes.ratio("abcd", "abxd") == 75
    assert codes.partial_ratio("abc", "xxabcxx") == 100
    assert codes.token_sort_ratio("b a", "a b") == 100 and codes.token_set_ratio("a b c", "c b a a") == 100


def test_weights():
    with pytest.raises(ValueError):
        S.weighted({"a": 0.5, "b": 0.6}, {"a": F.lit(1.0), "b": F.lit(1.0)}, normalise=False)
    with pytest.raises(ValueError):
        S.score("unknown", F.lit("a"), F.lit("b"))


def test_levenshtein_bound(spark):
    pairs = [("kitten", "sitting"), ("abc", "abc"), ("", ""), ("a", ""), ("lisboa", "lisbon")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for least in (0.3, 0.571, 0.58, 0.9):
        rows = frame.select(S.levenshtein(F.col("a"), F.col("b")).alias("s"), S.levenshtein_at_least(F.col("a"), F.col("b"), least).alias("ok")).collect()
        assert all(r.ok == (r.s >= least) for r in rows)


def test_corpus_tfidf_of_equal_texts(spark):
    pairs = spark.createDataFrame([(1, "rua augusta", "rua augusta"), (2, "", ""), (3, "rua", "")], "k int, a string, b string")
    found = {r.k: r.tfidf for r in tfidf.pair_cosine(pairs, "k", "a", "b", most=1.0).collect()}
    assert found == pytest.approx({1: 1.0, 2: 1.0, 3: 0.0})


def test_token_set_ratio_aligns_once_and_ratios_are_those_of_the_whole_texts(monkeypatch):
    import random

    from tessera.functions import codes

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above = 0
            for k, y in enumerate(b, 1):
                above, row[k] = row[k], above + 1 if x == y else max(row[k], row[k - 1])
        return round(200 * row[-1] / (len(a) + len(b))) if a or b else 100

    rng, met = random.Random(8), []
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    assert all(codes.ratio(a, b) == plain(a, b) for a in texts for b in texts)
    monkeypatch.setattr(codes, "ratio", lambda a, b: met.append(1) or plain(a, b))
    for a in texts:
        for b in texts:
            x, y = set(a.split()), set(b.split())
            both = " ".join(sorted(x & y))
            left, right = (f"{both} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
            want = 100 if both and (not x - y or not y - x) else max(plain(left, right), plain(both, left) if both else 0, plain(both, right) if both else 0)
            met.clear()
            assert codes.token_set_ratio(a, b) == want and len(met) <= 1
