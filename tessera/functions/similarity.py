"""Similarities of two texts in 0..1, each a function of two columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import codes
from tessera.functions.text import blank, let, normalize_characters, phonetic_words, simple, tokenize, tokens_of

Similarity = Callable[[Column, Column], Column]


def _both(x: Column, y: Column, score: Callable[[Column, Column], Column]) -> Column:
    """score of two values, each computed once."""
    return let(F.struct(x.alias("x"), y.alias("y")), lambda p: score(p["x"], p["y"]))


def _guarded(a: Column, b: Column, score: Column) -> Column:
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(score)


def levenshtein(a: Column, b: Column) -> Column:
    return _both(normalize_characters(a), normalize_characters(b), lambda x, y: _guarded(x, y, 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))))


def levenshtein_at_least(a: Column, b: Column, least: float) -> Column:
    """Whether levenshtein() reaches ``least``, giving up on a pair as soon as it can't."""
    x, y = normalize_characters(a), normalize_characters(b)
    longest = F.greatest(F.length(x), F.length(y))
    most = F.floor(longest * F.lit(1 - least) + F.lit(1e-9)).cast("int")
    close = F.abs(F.length(x) - F.length(y)) <= most
    return close & (1 - F.levenshtein(x, y) / F.greatest(longest, F.lit(1)) >= least - 1e-12)


def jaro_half(a: Column, b: Column) -> Column:
    x, y = normalize_characters(a), normalize_characters(b)
    return _guarded(x, y, codes.on_pairs(codes.jaro)(x, y))


def jaro_winkler_half(a: Column, b: Column) -> Column:
    """Half transpositions count."""
    x, y = normalize_characters(a), normalize_characters(b)
    return _guarded(x, y, codes.on_pairs(codes.jaro_winkler)(x, y))


def jaro_winkler_floored(a: Column, b: Column) -> Column:
    """The common variant, of texts as they are."""
    return _guarded(a, b, codes.on_pairs(partial(codes.jaro_winkler, floored=True))(a, b))


def _sets(x: Column, y: Column, empty: float | None) -> Column:
    """empty: of two empty sets; None if any empty set makes 0."""
    union = F.size(F.array_union(x, y))
    score = F.size(F.array_intersect(x, y)) / F.when(union > 0, union)
    none = (F.size(x) == 0) | (F.size(y) == 0)
    if empty is None:
        return F.when(none, 0.0).otherwise(score)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), empty).when(none, 0.0).otherwise(score)


def jaccard(a: Column, b: Column) -> Column:
    return _both(tokenize(a), tokenize(b), lambda x, y: _sets(x, y, 1.0))


def entity_jaccard(x: Column, y: Column) -> Column:
    """Of two arrays."""
    return _sets(F.array_distinct(x), F.array_distinct(y), 1.0)


def bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Of pairs of neighbouring characters; a missing text makes 0, equal ones 1."""
    sets = lambda x, y: _both(bigrams(x), bigrams(y), lambda v, w: _sets(v, w, None))
    return _both(simple(a), simple(b), lambda x, y: F.when(blank(x) | blank(y), 0.0).when(x == y, 1.0).otherwise(F.coalesce(sets(x, y), F.lit(0.0))))


def quick(method: Similarity) -> Similarity:
    """Missing or blank texts make 0, equal ones 1, whatever the method."""

    def score(a: Column, b: Column) -> Column:
        x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
        return F.when((F.trim(x) == "") | (F.trim(y) == ""), 0.0).when(x == y, 1.0).otherwise(F.coalesce(method(x, y), F.lit(0.0)))

    return score


def ngrams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def tfidf_pair(a: Column, b: Column) -> Column:
    """Cosine of TF-IDF where the two texts are the whole corpus: a term in one text weighs ln(3/2) + 1, in both 1."""
    one = math.log(1.5) + 1
    times = lambda t, terms: F.size(F.filter(terms, lambda w: w == t))

    def norm(own: Column, other: Column) -> Column:
        return F.sqrt(F.aggregate(F.array_distinct(own), F.lit(0.0), lambda s, t: s + F.pow(times(t, own) * F.when(F.array_contains(other, t), 1.0).otherwise(one), F.lit(2.0))))

    def cosine(x: Column, y: Column) -> Column:
        dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, t: s + (times(t, x) * times(t, y)).cast("double"))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / (norm(x, y) * norm(y, x))))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(score)

    return _both(*(let(tokens_of(F.array_join(tokenize(c), " ")), ngrams) for c in (a, b)), cosine)


def _coded(code: Callable[[Column], Column]) -> Similarity:
    def score(a: Column, b: Column) -> Column:
        x, y = (F.array_distinct(F.filter(F.transform(phonetic_words(c), lambda w: code(w)), lambda w: w != "")) for c in (a, b))
        return _both(x, y, lambda v, w: _sets(v, w, None))

    return score


soundex = _coded(F.soundex)


#: Words whose codes a worker remembers.
KNOWN_WORDS = 100_000


def _arrow_coded(function: Callable[[str], str]) -> Similarity:
    """Codes of the words that the texts have, in Arrow batches; either side without codes makes 0. A word is coded once, mostly."""
    known: dict[str, str] = {}

    def code(word: str) -> str:
        if (found := known.get(word)) is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            found = known[word] = function(word)
        return found

    def sets(words) -> set[str]:
        return {c for c in map(code, words) if c}

    def compare(a: str, b: str) -> float:
        x, y = sets(a.split()), sets(b.split())
        return len(x & y) / len(x | y) if x and y else 0.0

    return lambda a, b: codes.on_pairs(compare)(F.array_join(phonetic_words(a), " "), F.array_join(phonetic_words(b), " "))


metaphone, nysiis, double_metaphone = map(_arrow_coded, (codes.metaphone, codes.nysiis, codes.double_metaphone))


def exact(a: Column, b: Column) -> Column:
    return F.when(simple(a) == simple(b), 1.0).otherwise(0.0)


def fuzzy_best(a: Column, b: Column) -> Column:
    """The largest of four ratios, 0..100."""
    return codes.on_pairs(codes.best_ratio, "int")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def sequence_ratio(a: Column, b: Column) -> Column:
    return codes.on_pairs(codes.sequence_ratio)(a, b)


def weighted(parts: dict[str, float], scores: dict[str, Column], normalise: bool = True) -> Column:
    """A weighted sum; weights are made to add up to 1, or else must. A score that is null counts as 0."""
    total = sum(parts.values())
    if not parts or total <= 0:
        raise ValueError("weights must be positive")
    if not normalise and abs(total - 1) > 1e-6:
        raise ValueError(f"weights add up to {total}")
    return reduce(lambda x, y: x + y, (F.lit(w / total) * F.coalesce(scores[k], F.lit(0.0)) for k, w in parts.items()))


#: All similarities by name.
SIMILARITIES: dict[str, Similarity] = {
    "exact": exact, "levenshtein": levenshtein, "jaro": jaro_half, "jaro_winkler": jaro_winkler_half, "jaro_winkler_floored": jaro_winkler_floored, "jaccard": jaccard, "bigram": bigram_jaccard,
    "tfidf": tfidf_pair, "soundex": soundex, "metaphone": metaphone, "nysiis": nysiis, "double_metaphone": double_metaphone, "sequence": sequence_ratio,
}
# Thresholds of single similarities, weights of the hybrids and their threshold.
THRESHOLDS = {"levenshtein": 0.80, "jaro_winkler": 0.85, "jaccard": 0.60, "tfidf": 0.75, "soundex": 0.75, "metaphone": 0.80, "nysiis": 0.75}
HYBRIDS = {
    "levenshtein_jaccard_40_60": {"levenshtein": 0.4, "jaccard": 0.6}, "levenshtein_jaccard_30_70": {"levenshtein": 0.3, "jaccard": 0.7}, "levenshtein_jaccard_50_50": {"levenshtein": 0.5, "jaccard": 0.5},
    "jaro_winkler_tfidf_40_60": {"jaro_winkler": 0.4, "tfidf": 0.6}, "jaro_winkler_tfidf_50_50": {"jaro_winkler": 0.5, "tfidf": 0.5},
    "levenshtein_metaphone_60_40": {"levenshtein": 0.6, "metaphone": 0.4}, "jaro_winkler_metaphone_50_50": {"jaro_winkler": 0.5, "metaphone": 0.5}, "levenshtein_soundex_70_30": {"levenshtein": 0.7, "soundex": 0.3},
    "jaccard_metaphone_70_30": {"jaccard": 0.7, "metaphone": 0.3}, "tfidf_soundex_80_20": {"tfidf": 0.8, "soundex": 0.2}, "jaccard_soundex_75_25": {"jaccard": 0.75, "soundex": 0.25},
    "levenshtein_jaccard_metaphone_30_50_20": {"levenshtein": 0.3, "jaccard": 0.5, "metaphone": 0.2}, "jaro_winkler_tfidf_soundex_25_60_15": {"jaro_winkler": 0.25, "tfidf": 0.6, "soundex": 0.15},
    "levenshtein_jaccard_soundex_40_45_15": {"levenshtein": 0.4, "jaccard": 0.45, "soundex": 0.15}, "best_char_token_phonetic": {"jaro_winkler": 0.3, "jaccard": 0.5, "metaphone": 0.2},
}
HYBRID_THRESHOLD = 0.75
GRADES = {"street": (95, 85, 70, 60), "city": (90, 80, 65, 50), "postcode": (100, 90, 80, 70)}
GRADE_WEIGHTS = {"street": 0.5, "city": 0.35, "postcode": 0.15}
GRADE_MATCH = 0.6


def score(name: str, a: Column, b: Column) -> Column:
    if name not in SIMILARITIES:
        raise ValueError(f"no similarity {name!r}; there are {', '.join(SIMILARITIES)}")
    return SIMILARITIES[name](a, b)


def graded(percent: Column, component: str) -> Column:
    """A percentage to a grade of 0..1, linear between the component's thresholds."""
    exact_, good, part, least = map(float, GRADES[component])
    return F.when(percent >= exact_, 1.0).when(percent >= good, 0.7 + 0.3 * (percent - good) / (exact_ - good)).when(percent >= part, 0.4 + 0.3 * (percent - part) / (good - part)).when(percent >= least, 0.1 + 0.3 * (percent - least) / (part - least)).otherwise(0.0)
