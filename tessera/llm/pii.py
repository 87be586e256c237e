"""Personal data: fixed forms first, then contextual extraction bootstrapped from what they found.

Values of the fixed forms are seeds. The words beside them are lexical patterns; patterns and the values
they surround form a graph on which Spark scores both in turn. Patterns that end up reliable mark values beside
them that have nearly the form of their kind but not quite.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow, stored, texts_of

KINDS = ("email", "ip", "card", "phone")
ANY = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so longer runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = re.compile(r"\S+")
EDGE = "\"'()[]{}<>,.;:!?"
#: What a word that announces a value ends with.
CUES = ":=#"
#: Seeds (different values) that a pattern needs, rounds of scoring, and the confidence from which a pattern counts.
SUPPORT, ROUNDS, CONFIDENCE = 3, 3, 0.8
#: A neighbour of more code points, as a run of base64, stands in patterns as its digest.
WORD = 40
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, around array<struct<kind: string, start: int, end: int, value: string, pattern: string, seed: boolean>>"
_AROUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("pattern", pa.string()), ("seed", pa.bool_())]))


def emails(text: str) -> list[tuple[int, int]]:
    found, last = [], 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            last = m.end()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part := part.lstrip("0")) < 4 and int(part or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m.group().split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]


FORMS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def near_form(value: str) -> str | None:
    """The kind whose form ``value`` nearly has: what a reliable pattern may mark."""
    digits = sum(c in "0123456789" for c in value)
    if value.count("@") == 1 and not value.startswith("@") and not value.endswith("@"):
        return "email"
    if not re.fullmatch(r"\+?[0-9().-]+", value):
        return None
    if value.count(".") == 3 and digits >= 4 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value):
        return "ip"
    if 13 <= digits <= 19:
        return "card"
    return "phone" if 7 <= digits <= 12 else None


def tokens(text: str) -> list[tuple[int, int]]:
    """The runs of anything but white space."""
    return [m.span() for m in WORDS.finditer(text)]


def _keys(text: str, cuts: list[int]) -> Iterator[str]:
    """For each of the ascending cuts the key of the word up to it, in time linear in the text: digits alike, edges off, of more than WORD code points a digest."""
    at = len(text) - len(text.lstrip(EDGE))
    digest, short, n = blake2b(digest_size=16), "", 0
    for end in cuts:
        while end > at and text[end - 1] in EDGE:
            end -= 1
        if end > at:
            normal = re.sub("[0-9]+", "9", text[at:end].lower().replace("ς", "σ"))
            if at and text[at - 1] in "0123456789" and text[at] in "0123456789":
                normal = normal[1:]
            digest.update(normal.encode("utf-8", "surrogatepass"))
            n += len(normal)
            short = short + normal if n <= WORD else ""
            at = end
        yield short if n <= WORD else f"#{digest.hexdigest()}"


class Words:
    """Keys of the words beside values. A long run of anything but white space is read once forward and once backward for all values in it."""

    def __init__(self, text: str, runs: list[tuple[int, int]], starts: list[int], ends: list[int]):
        self.text, self.runs, self.starts, self.ends = text, runs, starts, ends
        self.long: dict[tuple[int, bool], dict[int, str]] = {}

    def __call__(self, k: int, cut: int, ahead: bool) -> str:
        """Of run k what stands before ``cut`` (the word is ahead of a value), or after it."""
        first, last = self.runs[k]
        a, b = (first, min(cut, last)) if ahead else (max(cut, first), last)
        if b - a <= WORD:
            return re.sub("[0-9]+", "9", self.text[a:b].strip(EDGE).lower())
        if (k, ahead) not in self.long:
            places = self.starts if ahead else self.ends
            inner = places[bisect_right(places, first) : bisect_left(places, last)]
            run = self.text[first:last]
            if ahead:
                cuts = [*inner, last]
                self.long[k, ahead] = dict(zip(cuts, _keys(run, [c - first for c in cuts]), strict=True))
            else:
                cuts = [*inner[::-1], first]
                self.long[k, ahead] = dict(zip(cuts, _keys(run[::-1], [last - c for c in cuts]), strict=True))
        return self.long[k, ahead][b if ahead else a]


def patterns(start: int, end: int, words: Words) -> list[str]:
    """The words beside a value: two before it, one on either side, and one before it that announces it; digits count alike."""
    runs = words.runs
    k = bisect_right(runs, start, key=lambda r: r[0]) - 1  # the value's own token: what stands before the value in it is a word, too
    at = [j for j in range(max(0, k - 2), k + 1) if runs[j][0] < start][-2:]
    before = [words(j, start, True) for j in at]
    k = bisect_right(runs, end, key=lambda r: r[1])
    after = [words(k, end, False)] if k < len(runs) else []
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if before and words.text[min(runs[at[-1]][1], start) - 1] in CUES:
        out.append(f"{before[-1]}: _")
    return out


def scan(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[dict]]:
    """Spans of the fixed forms, and all values with a pattern: seeds, and others of nearly such a form. Time is linear in the text."""
    if not ANY.search(text):
        return {k: [] for k in KINDS}, []
    base = {k: f(text) for k, f in FORMS.items()}
    values = [(k, a, b, True) for k, spans in base.items() for a, b in spans]
    taken = sorted((a, b) for _, a, b, _ in values)
    runs = tokens(text)
    k = 0
    for first, last in runs:
        if not ANY.search(text, first, last):
            continue
        value = text[first:last]
        start, end = last - len(value.lstrip(EDGE)), first + len(value.rstrip(EDGE))
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start < end and not (k < len(taken) and taken[k][0] < end) and (kind := near_form(text[start:end])):
            values.append((kind, start, end, False))
    words = Words(text, runs, sorted({a for _, a, _, _ in values}), sorted({b for _, _, b, _ in values}))
    return base, [{"kind": kind, "start": a, "end": b, "value": text[a:b], "pattern": p, "seed": seed} for kind, a, b, seed in values for p in patterns(a, b, words)]


def confident(edges: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS, least: float = CONFIDENCE) -> DataFrame:
    """``kind, pattern`` of the patterns to trust, from rows (kind, pattern, value, seed).

    A pattern's confidence is the mean score of its different values, a value's score 1 if it is a seed, else
    the confidence that one of its patterns is right, halved until a pattern has proved itself on seeds alone.
    """
    pairs = edges.groupBy("kind", "pattern", "value").agg(F.max(F.col("seed").cast("int")).alias("seed"))
    strong = pairs.groupBy("kind", "pattern").agg(F.sum("seed").alias("seeds"), F.count("*").alias("n")).where((F.col("seeds") >= support) & (F.col("seeds") < F.col("n")))
    graph = stored(pairs.join(strong.select("kind", "pattern"), ["kind", "pattern"], "left_semi").withColumn("score", F.col("seed").cast("double")))
    for _ in range(rounds):
        conf = graph.groupBy("kind", "pattern").agg(F.avg("score").alias("confidence"))
        miss = F.when(F.col("confidence") < 1, F.log(1 - F.col("confidence"))).otherwise(F.lit(-40.0))
        value = graph.join(conf, ["kind", "pattern"]).groupBy("kind", "value").agg(F.when(F.max("seed") == 1, 1.0).otherwise(1 - F.exp(F.sum(miss))).alias("score"))
        graph = stored(graph.drop("score").join(value, ["kind", "value"]))
    return graph.groupBy("kind", "pattern").agg(F.avg("score").alias("confidence")).where(F.col("confidence") >= least).select("kind", "pattern")


def extract(docs: DataFrame, *, id: str = "doc_id", text: str = "text", support: int = SUPPORT, rounds: int = ROUNDS, least: float = CONFIDENCE) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base, spans``.

    Counts are of the fixed forms, ``base`` lists their spans as kind:start:end, ``spans`` those and what trusted
    patterns add, both by kind as in KINDS, then start. Null texts are empty, equal rows and rows with one id or none are rows of their own; other
    columns are left out. Long texts take time in proportion, with or without spaces.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base, around = [], []
            for t in texts_of(batch.column(1)):
                found, values = scan(t)
                for column, k in zip(counts, KINDS, strict=True):
                    column.append(len(found[k]))
                base.append([f"{k}:{a}:{b}" for k in KINDS for a, b in found[k]])
                around.append(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.list_(pa.string())), pa.array(around, _AROUND)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "around"])

    rows = stored(arrow(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), find, SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    edges = rows.select("row", F.explode("around").alias("a")).select("row", "a.*")
    trusted = stored(confident(edges.select("kind", "pattern", "value", "seed"), support, rounds, least))
    more = edges.where("not seed").join(trusted, ["kind", "pattern"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    order = F.transform(F.coalesce("more", F.array().cast("array<struct<kind: string, start: int, end: int>>")), lambda m: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]).alias("k"), m["start"].alias("start"), m["end"].alias("end")))
    given = F.transform("base", lambda b: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.split(b, ":")[0]).alias("k"), F.split(b, ":")[1].cast("int").alias("start"), F.split(b, ":")[2].cast("int").alias("end")))
    spans = F.transform(F.array_sort(F.concat(given, order)), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"].cast("int")), s["start"], s["end"]))
    return rows.join(more, "row", "left").select("doc_id", *(f"n_{k}" for k in KINDS), "base", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
