"""Text normalization as column expressions.

Java's classes are ASCII by default; ``(?U)`` makes white space and word characters Unicode's. Accents are taken off by a
translation of the letters up to U+017F that decompose, built from the Unicode tables.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECOMPOSED = {chr(c): "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)) for c in range(0xC0, 0x180)}
ACCENTED = "".join(a for a, b in _DECOMPOSED.items() if len(b) == 1 and a != b)
PLAIN = "".join(_DECOMPOSED[a] for a in ACCENTED)

# Street prefixes by full word, stop words, abbreviations.
PREFIXES = {
    "avenida": "av avn avend avnda", "rua": "r", "praca": "prc pca", "largo": "lg lgo", "travessa": "tv trav", "alameda": "al", "calcada": "calc", "estrada": "estr",
    "beco": "bc", "jardim": "jd", "rodovia": "rod", "via": "v", "quadra": "qd quad", "lote": "lt", "conjunto": "cj conj", "setor": "set", "sitio": "st", "zona": "zn",
    "distrito": "dst", "vila": "vl", "bairro": "br", "residencial": "res resid", "comercial": "com comerc", "industrial": "ind indust", "urbano": "urb", "rural": "rur",
    "centro": "ctr cent", "area": "ar", "parque": "pq prq", "fazenda": "faz fzd", "chacara": "ch chac", "colonia": "col", "povoado": "pov pvd", "municipio": "mun",
    "regiao": "reg", "territorio": "terr", "localidade": "loc", "nucleo": "", "complexo": "",
}
STOP_WORDS = "de da do dos das e a o as os".split()
TOKEN_STOP_WORDS = "de da do dos das na no nos nas em ao aos para por com sem e ou a o os as um uma uns umas".split()
ABBREVIATIONS = {"r": "rua", "rua": "rua", "av": "avenida", "avenida": "avenida", "pc": "praça", "lg": "largo", "largo": "largo", "tv": "travessa", "travessa": "travessa", "est": "estrada", "estrada": "estrada", "al": "alameda", "alameda": "alameda", "bco": "beco", "beco": "beco", "cal": "calçada", "rot": "rotunda", "rotunda": "rotunda", "qta": "quinta", "quinta": "quinta", "urb": "urbanização"}
#: Acute accents that stand alone behind a vowel, as broken encodings leave them.
BROKEN = [(v + "´", v) for v in "aeiou"]
PHONETIC = [("ph", "f"), ("th", "t"), ("ch", "x"), ("lh", "ly"), ("nh", "ny"), ("rr", "r"), ("ss", "s"), ("ç", "c"), ("qu", "k"), ("gu", "g")]
PHONETIC_STOP_WORDS = (
    "rua r avenida av praca pc largo lg travessa tv beco estrada est alameda al numero num n andar dto esq frente tras de da do das dos e em na no com "
    "lisboa porto coimbra braga aveiro faro setubal leiria santarem evora beja portalegre vila real viana castelo guarda viseu"
).split()
TEXT_LIMIT = 32766


def words_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


PREFIX_OF = {short: full for full, shorts in PREFIXES.items() for short in (full, *shorts.split())}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; nested uses would otherwise multiply."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c == "")


def preprocess(c: Column) -> Column:
    """Lower case, no accents, no ASCII punctuation but hyphen and dot, single spaces, no stray acute accents."""
    x = collapse(F.regexp_replace(strip_accents(F.lower(c)), r"[!-,/:-@\[-`{-~]", ""))
    for broken, whole in BROKEN:
        x = F.replace(x, F.lit(broken), F.lit(whole))
    return F.coalesce(x, F.lit(""))


def changes(c: Column) -> Column:
    """Which steps of preprocess() change the text."""
    low = F.lower(c)
    plain = strip_accents(low)
    bare = F.regexp_replace(plain, r"[!-,/:-@\[-`{-~]", "")
    tidy = collapse(bare)
    fixed = tidy
    for broken, whole in BROKEN:
        fixed = F.replace(fixed, F.lit(broken), F.lit(whole))
    return F.struct((fixed != c).alias("preprocessing"), (low != c).alias("case"), (bare != plain).alias("punctuation"), (tidy != bare).alias("whitespace"), (fixed != tidy).alias("encoding"))


def tokens_of(c: Column) -> Column:
    """Words between single spaces; none of an empty text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def _full(word: Column) -> Column:
    return F.coalesce(F.element_at(words_map(PREFIX_OF), F.regexp_replace(word, r"\.+$", "")), word)


def _without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def normalize_street(c: Column) -> Column:
    """The first word's prefix in full, then the other words but stop words."""

    def named(words: Column) -> Column:
        rest = _without(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), STOP_WORDS)
        return F.when(F.size(words) > 0, F.array_join(F.concat(F.array(_full(F.get(words, 0))), rest), " ")).otherwise("")

    return let(tokens_of(preprocess(c)), named)


def normalize_query(c: Column) -> Column:
    """Every word's prefix in full, but stop words."""
    return F.array_join(_without(F.transform(tokens_of(preprocess(c)), _full), STOP_WORDS), " ")


def normalize_postcode(c: Column) -> Column:
    """dddd-ddd, if there are exactly seven digits."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 7, F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 3)))


def normalize_housenumber(c: Column) -> Column:
    """The first number and, preprocessed, what stands behind it; null without digits."""
    number = F.regexp_extract(c, r"(\d+)", 1)
    behind = preprocess(F.regexp_extract(c, r"(?s)\d+(.*)$", 1))
    return F.when((number != "") & (F.length(number) <= 18), F.struct(number.cast("long").alias("primary"), F.nullif(behind, F.lit("")).alias("specifier")))


def sane_housenumber(c: Column) -> Column:
    return F.when(c.between(1, 999999), c)


def clean_text(c: Column) -> Column:
    return F.nullif(F.left(F.replace(F.trim(c), F.lit("\u0000"), F.lit("")), F.lit(TEXT_LIMIT)), F.lit(""))


def simple(c: Column) -> Column:
    return F.lower(F.trim(c))


def normalize_characters(c: Column) -> Column:
    """Lower case, no accents, single spaces; punctuation stays."""
    return F.coalesce(collapse(strip_accents(F.lower(c))), F.lit(""))


def normalize_tokens(c: Column) -> Column:
    """Lower case, no accents, signs to spaces (not underscores), single spaces."""
    return F.coalesce(collapse(F.regexp_replace(strip_accents(F.lower(c)), r"(?U)[^\w\s]", " ")), F.lit(""))


def expand(words: Column) -> Column:
    """Abbreviations in full. The values carry accents although the words have lost theirs."""
    return F.transform(words, lambda w: F.coalesce(F.element_at(words_map(ABBREVIATIONS), F.regexp_replace(w, r"\.+$", "")), w))


def tokenize(c: Column) -> Column:
    words = expand(tokens_of(normalize_tokens(c)))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*TOKEN_STOP_WORDS))


def normalize_phonetic(c: Column) -> Column:
    x = strip_accents(F.lower(F.trim(c)))
    for a, b in PHONETIC:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.coalesce(collapse(F.regexp_replace(x, r"[^a-z\s]", "")), F.lit(""))


def phonetic_words(c: Column) -> Column:
    return F.filter(tokens_of(normalize_phonetic(c)), lambda w: (F.length(w) >= 3) & ~w.isin(*PHONETIC_STOP_WORDS))


def title(c: Column) -> Column:
    """A capital after everything that is not a letter, small letters elsewhere."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.expr("''"), p.substr(F.lit(2), F.length(p)))), "")


def completeness(*columns: Column) -> Column:
    """The share of the fields that are there."""
    return sum((F.when(blank(c), 0).otherwise(1) for c in columns[1:]), F.when(blank(columns[0]), 0).otherwise(1)) / F.lit(float(len(columns)))


def normalize_city(c: Column, exact: Column) -> Column:
    """``exact``: whether the preprocessed name is among the canonical ones; see operators.cities for the fuzzy rest."""
    return F.when(exact, preprocess(c))


def component(street: Column | None = None, city: Column | None = None, postcode: Column | None = None) -> Column:
    """A component normalized, or else at least preprocessed."""
    if street is not None:
        return normalize_street(street)
    if postcode is not None:
        return F.coalesce(normalize_postcode(postcode), preprocess(postcode))
    return preprocess(city)
