"""Portuguese stems by the published Snowball rules."""

from __future__ import annotations

# The vowels and suffixes of the published algorithm.
VOWELS = "aeiouáéíóúâêô"
NOUNS = (
    "eza", "ezas", "ico", "ica", "icos", "icas", "ismo", "ismos", "ável", "ível", "ista", "istas", "oso", "osa", "osos", "osas", "amento", "amentos", "imento", "imentos",
    "adora", "ador", "aça~o", "adoras", "adores", "aço~es", "ante", "antes", "ância",
)
VERBS = (
    "ada", "ida", "ia", "aria", "eria", "iria", "ará", "ara", "erá", "era", "irá", "ava", "asse", "esse", "isse", "aste", "este", "iste", "ei", "arei", "erei", "irei", "am", "iam",
    "ariam", "eriam", "iriam", "aram", "eram", "iram", "avam", "em", "arem", "erem", "irem", "assem", "essem", "issem", "ado", "ido", "ando", "endo", "indo", "ara~o", "era~o", "ira~o",
    "ar", "er", "ir", "as", "adas", "idas", "ias", "arias", "erias", "irias", "arás", "aras", "erás", "eras", "irás", "avas", "es", "ardes", "erdes", "irdes", "ares", "eres", "ires",
    "asses", "esses", "isses", "astes", "estes", "istes", "is", "ais", "eis", "íeis", "aríeis", "eríeis", "iríeis", "áreis", "areis", "éreis", "ereis", "íreis", "ireis", "ásseis",
    "ésseis", "ísseis", "áveis", "ados", "idos", "ámos", "amos", "íamos", "aríamos", "eríamos", "iríamos", "áramos", "éramos", "íramos", "ávamos", "emos", "aremos", "eremos", "iremos",
    "ássemos", "êssemos", "íssemos", "imos", "armos", "ermos", "irmos", "eu", "iu", "ou", "ira", "iras",
)
RESIDUES = ("os", "a", "i", "o", "á", "í", "ó")


def _after(word: str, start: int) -> int:
    """The place behind the first consonant that follows a vowel."""
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _body(word: str) -> int:
    """Where verb endings may begin."""
    if len(word) < 3:
        return len(word)
    first, second = word[0] in VOWELS, word[1] in VOWELS
    if not first and second:
        return 3
    # from the third letter on: a vowel after a consonant, a consonant after two vowels
    return next((k + 1 for k in range(2, len(word)) if (word[k] in VOWELS) != second), len(word))


def stem(word: str) -> str:
    w = word.lower().replace("ã", "a~").replace("õ", "o~")
    r1 = _after(w, 0)
    r2, rv = _after(w, r1), _body(w)

    def ends(suffixes, start: int) -> str:
        """The longest of the suffixes that stands at the end and in the region."""
        return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= start), key=len, default="")

    def longest(suffixes) -> str:
        return ends(suffixes, 0)

    def cut(suffix: str, start: int) -> bool:
        nonlocal w
        if suffix and w.endswith(suffix) and len(w) - len(suffix) >= start:
            w = w[: -len(suffix)]
            return True
        return False

    def noun() -> bool:
        """The longest ending of all decides, whether or not its region allows it."""
        nonlocal w
        found = longest((*NOUNS, "logia", "logias", "uça~o", "uço~es", "ência", "ências", "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"))
        if not found:
            return False
        if found in NOUNS:
            return cut(found, r2)
        for ending, new in ((("logia", "logias"), "log"), (("uça~o", "uço~es"), "u"), (("ência", "ências"), "ente")):
            if found in ending:
                if cut(found, r2):
                    w += new
                    return True
                return False
        if found == "amente":
            if not cut(found, r1):
                return False
            if cut("iv", r2):
                cut("at", r2)
            else:
                cut(longest(("os", "ic", "ad")), r2)
            return True
        if found == "mente":
            return cut(found, r2) and (cut(longest(("ante", "avel", "ível")), r2) or True)
        if found in ("idade", "idades"):
            return cut(found, r2) and (cut(longest(("abil", "ic", "iv")), r2) or True)
        if found in ("iva", "ivo", "ivas", "ivos"):
            return cut(found, r2) and (cut("at", r2) or True)
        if len(w) - len(found) >= rv and w[: -len(found)].endswith("e"):
            w = w[: -len(found)] + "ir"
            return True
        return False

    if noun() or cut(ends(VERBS, rv), rv):
        if w.endswith("ci"):
            cut("i", rv)
    else:
        cut(ends(RESIDUES, rv), rv)
    if w[-1:] in ("e", "é", "ê") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")):
            cut(w[-1], rv)
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")
