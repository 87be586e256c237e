"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are range-sorted by length in Spark. Equal lengths are interchangeable, so sorted documents
and sorted gaps are both runs: at most one run of documents for each length below the capacity,
and a few runs of sequences for each gap, whatever the number of documents. A superstep takes the longest
remaining documents, sweeps the gaps upward from their successor (the smallest gap that holds them),
gives ranks of documents to ranks of sequences, which settles who gets a contested gap, and puts the
shrunken gaps back. What comes out says for ranges of ranks where they go; Spark applies it to the sorted
documents. The result is that of sequential best-fit-decreasing.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import arrow, chunks, stored, texts_of

CAPACITY = 4096
END = 1
#: Words whose ids a worker keeps, and their length: longer ones seldom come again. When full it starts anew.
CACHE_WORDS, CACHE_LETTERS = 250_000, 9
#: Code points of text that are split at once.
CHUNK = 4 << 20
#: Signs that often follow a word; no apostrophe, with which the tokenizer begins units of its own.
SIGNS = ".,!?;:$%&*#|"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_tokenizers: dict[str, tuple[Tokenizer, np.ndarray, dict[str, bytes], tuple[str, ...]]] = {}


def _lower(text: str, added: tuple[str, ...] = ()) -> str:
    """Latin-1 texts in lower case, unless that would make one of the tokens that are looked for in the text as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    low = text.lower()
    return text if any(t in low for t in added) else low


def _letters(word: str) -> bool:
    """Whether the tokenizer, which composes and lowers first, sees letters alone."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


class Words:
    """Ids of a text, word by word.

    The tokenizer's rules never reach across a space or a line feed, nor from a letter into the signs behind it, and it
    ignores case (only Latin-1 is lowered here, where case has no exceptions). So its ids for a text are those
    of such parts, and parts that came before are looked up. Words of letters alone are one unit each of the tokenizer;
    many are encoded as one text, whose ids tell where a unit ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the library's pool spin
        if path not in _tokenizers:
            tokenizer = Tokenizer.from_file(path)
            vocabulary = tokenizer.get_vocab(with_added_tokens=False)
            ends = np.zeros(max(vocabulary.values()) + 1, bool)
            ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
            added = tuple(str(t.content).lower() for t in tokenizer.get_added_tokens_decoder().values())
            _tokenizers[path] = tokenizer, ends, {"": b""}, added
        self.tokenizer, self.ends, self.known, self.added = _tokenizers[path]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The texts' ids as little-endian unsigned 32-bit numbers."""
        offsets = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        return [x for a, b in chunks(offsets, CHUNK) for x in self._ids(texts[a:b])]

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Each different word is looked up once; the ids are then gathered for all its places."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        split = pc.split_pattern(pa.array([_lower(x, self.added).replace("\n", " ") for x in texts], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(known.get, words))
        if None in found:
            new = {w for w, x in zip(words, found, strict=True) if x is None}
            self._learn(new)
            found = [known[w] if x is None else x for w, x in zip(words, found, strict=True)]
            for w in new:
                if len(w) > CACHE_LETTERS:
                    del known[w]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, many = np.cumsum(size) - size, size[index]
        ends = np.r_[0, np.cumsum(many)]
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[index] - ends[:-1], many) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, new: set[str]) -> None:
        known, plain, other, joined = self.known, set(), set(), []
        for w in new:
            if _letters(w):
                plain.add(w)
            elif _letters(core := w.rstrip(SIGNS)):
                joined.append((w, core, w[len(core) :]))
                if core not in known:
                    plain.add(core)
                if w[len(core) :] not in known:
                    other.add(w[len(core) :])
            else:
                other.add(w)
        words = list(plain)
        parts = [words[k : k + 1000] for k in range(0, len(words), 1000)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                other.update(part)
                continue
            raw, at = ids.tobytes(), (4 * ends).tolist()
            known.update(zip(part, (raw[a:b] for a, b in zip([0, *at], at, strict=False)), strict=True))
        rest = list(other)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w, core, tail in joined:
            known[w] = known[core] + known[tail]


def pieces(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is the ids of its text (null: none) and then ``end``; only longer ones than
    ``capacity`` are cut, into pieces of that length, the last of which may be shorter. ``tokenizer`` is the
    path of a file that every machine has. Equal rows, rows with one id and rows without an id are documents of their own; other columns are
    left out, whatever their names.
    """
    tail = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, raw in zip(batch.column(0).to_pylist(), words.ids(texts_of(batch.column(1))), strict=True):
                raw += tail
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    for column, x in zip(out, (doc, k, at // 4, len(ids) // 4, zlib.crc32(ids)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return arrow(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), cut, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where ranges of ranks go, and the number of sequences.

    ``counts``: documents of each length. A step (length, first rank, end rank, k, sequence, offset) sends the rank r to
    sequence + (r - first) // k, at offset + ((r - first) % k) * length.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # of each gap: (first sequence, sequences)
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs:
                insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            k = gap // length
            full = min(n, left // k)
            if full:
                steps.append((length, rank, rank + full * k, k, first, capacity - gap))
                put(gap - k * length, first, full)
                left, rank = left - full * k, rank + full * k
            if left and full < n:  # the last sequence takes the rest, fewer than k
                steps.append((length, rank, rank + left, k, first + full, capacity - gap))
                put(gap - left * length, first + full, 1)
                full, left = full + 1, 0
            put(gap, first + full, n - full)
    return steps, opened


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``parts`` with ``sequence_id`` and ``offset``: as few sequences of ``capacity`` as best-fit finds.

    Needs a column ``length`` (1 to capacity). Equal rows stay apart. No rows give no sequences.
    """
    names = parts.columns
    parts = stored(parts)  # range-sorting reads them twice
    ranked = stored(parts.repartitionByRange(F.col("length"), F.xxhash64(*names)).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("length").withColumn("_row", F.monotonically_increasing_id()))
    # At most one row for each partition and length in it, so partitions + capacity rows.
    runs = ranked.groupBy("_part", "length").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    known = sorted(tuple(r) for r in runs.select("length", "_part", "n", "first").collect())
    counts: dict[int, int] = {}
    starts = []
    for length, part, n, first in known:
        starts.append((part, length, first, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    steps, _ = best_fit(counts, capacity)
    shared = parts.sparkSession.sparkContext.broadcast((sorted(starts), np.array(sorted(steps) or np.zeros((0, 6)), np.int64).reshape(-1, 6)))
    out = ranked.drop("_part", "_row").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, steps = shared.value
        begin = {(part, length): (first, rank) for part, length, first, rank in starts}
        key = steps[:, 0] * (1 << 40) + steps[:, 1]
        for batch in batches:
            length, part, row = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "_part", "_row"))
            if not len(row):
                continue
            pairs, inverse = np.unique(part * (1 << 20) + length, return_inverse=True)
            first, rank = np.array([begin[int(x) >> 20, int(x) & ((1 << 20) - 1)] for x in pairs], np.int64).T
            rank = row - first[inverse] + rank[inverse]
            s = steps[np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1]
            sequence, slot = np.divmod(rank - s[:, 1], s[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(s[:, 4] + sequence), pa.array(s[:, 5] + slot * length)], names=[*names, "sequence_id", "offset"])

    return arrow(ranked, place, out)
