"""Set similarity join on word n-grams: rare-first prefixes, filters by length, position and suffix, exact verification.

Large sets are cut into parts by their members' hashes: where two sets have num / den of their union in common, they have so in one
of the parts at least. Prefixes and filters go by the parts, which are small enough for a sketch of 64 bits to tell sets apart
that share a member by chance. Without it such candidates grow with the square of the documents, and run together into one component.

The order of n-grams is by how often hash cells of all documents' n-grams were met, which is a
table of fixed size; any order that all documents share gives right results, and one that puts rare
n-grams first gives few candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow, chunks, join_small, stored, strings
from tessera.llm.components import SKETCHED, Packer, bucket_edges, buckets_for, by_sets, connected, links
from tessera.llm.hashing import between, distinct, lowered, mix, prefix

#: Cells that n-grams are counted in, sent and summed in slices.
CELLS, SLICES = 1 << 20, 256
CHUNK = 1 << 17
#: Sets that a task remembers having sent.
MET = 200_000
#: N-grams that a range of a set's profile is meant for.
PER_RANGE = 32
#: N-grams that a part of a set is meant for at most, and times that a set is halved for it at most.
PART, HALVINGS = 128, 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.random.RandomState(99).randint(0, 1 << 62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct n-grams of each row's words, A-Z in lower case; of fewer words, of the sequence as a whole."""
    rows = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * rows
    data = lowered(data)
    word = ~_SPACE[data]
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    before = np.r_[False, word[:-1]] & ~bound[:-1]
    after = np.r_[word[1:], False] & ~bound[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    h = between(prefix(data), start, end)
    doc = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(doc, minlength=rows)
    first = np.r_[0, np.cumsum(count)]
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        grams += h[k : k + len(grams)] * _ODD[k]
    grams = mix(grams + np.uint64(n))
    out = []
    for k in range(rows):
        a, m = first[k], int(count[k])
        if m >= n:
            out.append(distinct(grams[a : a + m - n + 1]))
        elif m:
            with np.errstate(over="ignore"):
                out.append(mix((h[a : a + m] * _ODD[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def name_of(grams: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def profile(grams: np.ndarray) -> bytes:
    """How many n-grams of a set fall in each of some ranges of hashes, about PER_RANGE in one: little endian, 2 bytes each, 65535 for that or more."""
    bits = min(12, max(4, int(len(grams) // PER_RANGE).bit_length()))
    return np.minimum(np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 0xFFFF).astype("<u2").tobytes()


def by_profiles(num: int, den: int) -> Callable[[list, list], Iterator[tuple[int, int]]]:
    """Compares by a suffix filter: two sets have no more in common than, range by range, the smaller count. Finds links that connect at least what true links would."""

    def compare(nodes: list, profiles: list) -> Iterator[tuple[int, int]]:
        every = [np.frombuffer(p or b"", "<u2").astype(np.int32) for p in profiles]
        width, size = np.array(list(map(len, every))), np.array([x.sum() for x in every], np.int64)
        full = np.array([bool((x == 0xFFFF).any()) for x in every])
        tables = {}  # of each width, the sets that have at least so many ranges, brought to that many
        for w in np.unique(width[width > 0]).tolist():
            rows = np.flatnonzero(width >= w)
            tables[w] = rows, np.array([every[r].reshape(w, -1).sum(axis=1) for r in rows])
        fresh = width > 0
        for seed in range(len(every)):
            queue = [seed] if fresh[seed] else []
            fresh[seed] = False
            while queue:
                a = queue.pop()
                for w, (rows, table) in tables.items():  # two sets meet at the smaller width of the two
                    if w > width[a]:
                        continue
                    open_ = fresh[rows] & (np.minimum(width[rows], width[a]) == w)
                    mine = rows[open_]
                    most = np.minimum(table[open_], table[np.searchsorted(rows, a)]).sum(axis=1)
                    passed = ((num + den) * most >= num * (size[mine] + size[a])) & (np.minimum(size[mine], size[a]) * den >= num * np.maximum(size[mine], size[a]))
                    found = mine[passed | full[mine] | full[a]]
                    fresh[found] = False
                    for b in found.tolist():
                        queue.append(b)
                        yield a, b

    return compare


def sets_of(n: int) -> Callable[[list[str], list[str]], list[np.ndarray]]:
    """Sets of texts; none for a text whose set is not the one named."""

    def sets(names: list[str], texts: list[str]) -> list[np.ndarray]:
        data, offsets = strings(pa.array(texts, pa.large_string()))
        found = [s for a, b in chunks(offsets, CHUNK) for s in word_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)]
        return [s if name_of(s).hex() == x else s[:0] for x, s in zip(names, found, strict=True)]

    return sets


def _by_chunk(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = strings(column)
    for a, b in chunks(offsets, CHUNK):
        yield a, word_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)


def measured(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n, name, profile) of documents, without a name where there are no n-grams, and rows (slice, counts) of the cells that a task has met. docs: doc_id, text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["doc_id", "n", "name", "profile", "slice", "counts"]
        kind = None
        for batch in batches:
            size, named, profiles, kind = [], [], [], batch.column(0).type
            for _, sets in _by_chunk(batch.column(1), n):
                size += map(len, sets)
                named += [name_of(s).hex() if len(s) else None for s in sets]
                profiles += [profile(s) if len(s) else None for s in sets]
                cells += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=CELLS)
            none = [None] * len(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(named, pa.string()), pa.array(profiles, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)
        if cells.any():
            none = [None] * SLICES
            yield pa.RecordBatch.from_arrays([pa.array(none, kind), pa.array(none, pa.int64()), pa.array(none, pa.string()), pa.array(none, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(list(map(_narrow, cells.reshape(SLICES, -1))), pa.binary())], names=names)

    return arrow(docs, measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, name string, profile binary, slice int, counts binary")


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in 1, 2 or 4 bytes each."""
    most = counts.max()
    return np.minimum(counts, 0xFFFFFFFF).astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _cells(rows: DataFrame) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(c, f"<u{len(c) * SLICES // CELLS}").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(c, 0xFFFFFFFF).astype("<u4").tobytes() for c in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((SLICES, CELLS // SLICES), np.uint32)
    for k, c in arrow(rows.repartition("slice"), add, "slice int, counts binary").collect():  # SLICES rows, 4 MB together
        out[k] = np.frombuffer(c, "<u4")
    return out.reshape(-1)


def halvings(size: np.ndarray) -> np.ndarray:
    """How often sets of so many members are halved until a part is meant for PART at most."""
    return np.searchsorted(PART << np.arange(HALVINGS), size)


def parts_of(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, ...]:
    """Of sorted sets, in all halvings that a set of similarity num / den can have: member, number of its part, and of each part set and halvings."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    low = halvings(size)
    times = halvings(size * den // num) - low + 1
    of = np.repeat(np.arange(len(sets)), times)
    level = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    each = size[of]
    start = np.repeat((np.cumsum(size) - size)[of] - (np.cumsum(each) - each), each)
    member = np.concatenate(sets)[start + np.arange(len(start))]
    one = np.repeat(np.arange(len(of)), each)
    range_ = member >> np.uint64(1) >> (63 - level[one]).astype(np.uint64)
    new = np.r_[True, (one[1:] != one[:-1]) | (range_[1:] != range_[:-1])]
    return member, np.cumsum(new) - 1, of[one[new]], level[one[new]]


def prefixes(docs: DataFrame, n: int, num: int, den: int, cells: np.ndarray, buckets: int) -> DataFrame:
    """Packed entries (key, node, n, at, sketch): the n-grams of the prefix of each part of a document, rarest cells first; a node is a set, by the first half of its name.

    Two parts of similarity num / den share one of the first size - ceil(size * num / den) + 1 n-grams of either. Sets so small that
    none but their equals are similar to them have no entries.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, packer = shared.value, Packer(buckets, sketched=True)
        met_before: set[bytes] = set()  # a task sends a set once
        for batch in batches:
            for _, sets in _by_chunk(batch.column(0), n):
                fresh = {x: s for x, s in zip(map(name_of, sets), sets, strict=True) if len(s) * den >= num * (len(s) + 1) and x not in met_before}
                if len(met_before) < MET:
                    met_before.update(fresh)
                if not fresh:
                    continue
                nodes = np.frombuffer(b"".join(x[:8] for x in fresh), ">i8")
                every, part, of, level = parts_of(list(fresh.values()), num, den)
                size = np.bincount(part)
                start = np.cumsum(size) - size
                sketch = np.bitwise_xor.reduceat(np.uint64(1) << (every & np.uint64(63)), start)
                met = cells[every >> np.uint64(44)]
                order = np.lexsort((met, part))  # stable, and sets are sorted
                at = np.arange(len(every)) - start[part]
                most = size + num * size // -den + 1
                kept = (at < most[part]) & (met[order] > 1)  # met once: in no other document
                at, every, part = at[kept], every[order[kept]], part[kept]
                yield from packer.add(mix(every + level[part].astype(np.uint64) * _ODD[-1]), nodes[of[part]], size[part], at, sketch[part])
        yield from packer.flush()

    return arrow(docs, rows, "bucket int, block binary")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents link when den * intersection >= num * union of their sets of word n-grams; a component is the smallest id
    reachable by links. Null, empty and wordless texts have no n-grams and link with nothing. Rows with one
    id are one document, which links by any of its texts; rows without an id are in no component. Ids may be of any type with an order.
    Texts of equal sets are one node, compared once for all, whatever their ids. Other columns are left out.
    """
    plain = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    seen = stored(measured(plain, n))
    sized = seen.where("slice is null").select("doc_id", "n", "name")
    known = sized.where("name is not null and doc_id is not null")
    classes = stored(known.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count("*").alias("rows")))
    cells = _cells(seen.where("slice is not null").select("slice", "counts"))
    entries = classes.agg(F.sum(F.expr(f"n - ceil(n * {num} / {den}) + 1 + 2 * n / {PART}"))).first()[0] or 0
    own = plain.where("doc_id is not null").select("text")
    candidates = stored(connected(bucket_edges(prefixes(own, n, num, den, cells, buckets_for(int(entries), SKETCHED.itemsize)), num, den, sketched=True)))
    # From here on a set goes by its whole name. Profiles, a small part of the texts, part most of what prefixes brought together.
    half = F.conv(F.substring("name", 1, 16), 16, -10).cast("long").alias("half")
    near = stored(join_small(classes.select("name", "first", "n", half), candidates.withColumnRenamed("node", "half"), "half").select(F.col("name").alias("node"), "first", F.col("component").alias("comp"), (F.col("n") * 8).alias("weight")))
    shown = seen.select(F.col("name").alias("node"), F.col("doc_id").alias("first"), F.col("profile").alias("text"))
    shown = stored(join_small(shown, near.select("node", "first"), ["node", "first"], row_bytes=128).dropDuplicates(["node"]).select("node", "text"))
    likely = stored(connected(links(near.select("node", "comp", F.col("weight") / 8).toDF("node", "comp", "weight"), lambda where: shown.join(where, "node"), by_profiles(num, den))).toDF("node", "comp"))
    near = stored(join_small(near.drop("comp"), likely, "node", row_bytes=128))

    def members(where: DataFrame) -> DataFrame:
        """The texts come last, so that they are shuffled once."""
        return join_small(plain.withColumnRenamed("doc_id", "first"), stored(where.join(near.select("node", "first"), "node")), "first")

    edges = links(near.select("node", "comp", "weight"), members, by_sets(sets_of(n), num, den))
    # The texts of one document.
    several = known.groupBy("doc_id").agg(F.min("name").alias("u"), F.max("name").alias("v")).where("u <> v").select("doc_id", "u")
    several = join_small(known, stored(several), "doc_id").where("name <> u").select("u", F.col("name").alias("v")).distinct()
    whole = stored(connected(edges.unionByName(several)).toDF("name", "comp"))
    least = join_small(classes, whole, "name").groupBy("comp").agg(F.min("first").alias("component_id"))
    joined = whole.join(least, "comp").select("name", "component_id")
    copied = classes.where("rows > 1").select("name", "first").join(whole.select("name"), "name", "left_anti").toDF("name", "component_id")
    found = join_small(sized, stored(joined.unionByName(copied)), "name", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
