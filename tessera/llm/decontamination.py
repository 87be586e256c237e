"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, each text scanned once.

Letters of the automaton are words: every word of the items gets one code point, all others share
``OTHER``. A window of 13 words is then a string of 13 letters, and a scan costs one dictionary
lookup and one automaton step a word, however many items there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow, stored

#: After bytes.lower(), which changes A-Z only: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OTHER = "\0"
#: Windows in one automaton (about 13 nodes each); more items take another scan each so many.
MAX_WINDOWS = 200_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def windows(rows: list[tuple[str, str]], size: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each window of the items, with the ids of those that hold it; an item of fewer words is one window."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in rows:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[k : k + size]), set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


def letters(found: dict) -> dict[bytes, str]:
    codes: dict[bytes, str] = {}
    for window in found:
        for w in window:
            if w not in codes:
                n = len(codes) + 1
                codes[w] = chr(n if n < 0xD800 else n + 0x800)
    return codes


class Scanner:
    """Rebuilt from the windows in each task that uses it."""

    def __init__(self, found: dict[tuple[bytes, ...], list[str]]):
        self.codes, self.automaton = letters(found), ahocorasick.Automaton()
        for window, items in found.items():
            self.automaton.add_word("".join(map(self.codes.__getitem__, window)), (len(window), items))
        if found:
            self.automaton.make_automaton()
        self.found = bool(found)

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """Words, runs of hit words (first, end), items."""
        w, code = words(text), self.codes.get
        runs: list[list[int]] = []
        items: set[str] = set()
        if self.found and w:
            for last, (size, ids) in self.automaton.iter("".join([code(x, OTHER) for x in w])):
                items.update(ids)
                first = last - size + 1
                while runs and first <= runs[-1][0]:  # a longer window may begin before a shorter one
                    runs.pop()
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = last + 1
                else:
                    runs.append([first, last + 1])
        return len(w), runs, items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point ranges of the text as it was."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    return [(len(raw[: at[a][0]].decode("utf-8", "ignore")), len(raw[: at[b - 1][1]].decode("utf-8", "ignore"))) for a, b in runs]


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, n_hit, items, spans``.

    ``n_hit`` counts the words inside occurrences of windows, ``items`` lists the items whose windows
    occur, ``spans`` the hit runs as code point ranges of the original text. Null and empty texts have
    no words. Items without words, or without an id, are left out; rows with the same id count as one item. Ids of documents may be of any type.
    The items are gathered on the driver ``max_windows`` windows at a time, one scan of the texts for each.
    """
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator()
    left = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))
    part: list[tuple[str, str]] = []
    size, shards = 0, 0
    for r in rows:
        part.append((r.i, r.t))
        size += max(1, len(words(r.t)) - window + 1)
        if size >= max_windows:
            left = stored(_scan(left, windows(part, window), keep=True)) if shards else _scan(left, windows(part, window), keep=True)
            part, size, shards = [], 0, shards + 1
    if shards:
        left = stored(left)
    out = _scan(left, windows(part, window), keep=False)
    return out.select(
        F.col("id").alias(id), "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.words)").alias("n_hit"),
        "items", F.expr("transform(spans, s -> struct(s.start as start, s.end as end))").alias("spans"),
    )


def _scan(left: DataFrame, found: dict, keep: bool) -> DataFrame:
    """keep: the text goes on to a further scan."""
    shared = left.sparkSession.sparkContext.broadcast(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            ids, rows = batch.column("id"), batch.select(["text", "runs", "items"]).to_pydict()
            out: list[list] = [[], [], [], []]
            for text, old, had in zip(rows["text"], rows["runs"], rows["items"], strict=True):
                n, runs, items = scanner.scan(text)
                runs = _merged([*runs, *([a, b] for a, b in zip(old[::2], old[1::2], strict=True))])
                for column, x in zip(out, (text, n, runs, sorted(items.union(had))), strict=True):
                    column.append(x)
            texts, n, runs, items = out
            if keep:
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array([[x for r in y for x in r] for y in runs], pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["id", "text", "runs", "items"])
            else:
                where = [[{"start": s, "end": e, "words": b - a} for (a, b), (s, e) in zip(y, spans(t, y), strict=True)] if y else [] for t, y in zip(texts, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int64())])))], names=["id", "n_words", "items", "spans"])

    kind = left.schema["id"].dataType.simpleString()
    return arrow(left, scan, f"id {kind}, text string, runs array<int>, items array<string>" if keep else f"id {kind}, n_words long, items array<string>, spans array<struct<start: int, end: int, words: long>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of decontaminate()."""
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))
