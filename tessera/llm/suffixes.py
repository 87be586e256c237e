"""Removal of long repeated byte strings by a hash-compared suffix sort over anchored pieces.

Every window of LENGTH bytes has an anchor: of the GRAM-byte strings in it, the leftmost with the smallest hash. Equal windows
have their anchors at the same place in them, so only texts around anchors of equal content can share one. A run of
windows with one anchor is a piece. Pieces whose anchor occurs again are counted by their bytes, so that each different one goes on once. Those of one
anchor meet in one task: their suffixes from the anchor on are mergesorted, each comparison a binary search over
prefix hashes for the common extension, and the order is verified byte by byte; the extension to the neighbours bounds
which windows of a piece can occur in another one, and those are looked up by hash and compared byte by byte as well.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow, chunks, join_small, stored, strings
from tessera.llm.hashing import between, mix, prefix, quick_between, quick_prefix, quick_windows

LENGTH, GRAM = 400, 100
#: Bytes hashed at once; bytes and pieces that a task sorts at once. An anchor with more pieces goes window by window instead.
CHUNK, SORT_BYTES, SORT_PIECES = 1 << 16, 1 << 19, 20_000
#: Entries up to which the finds are broadcast to the documents.
FEW = 2_000_000
#: Bits of a piece's hash that name it; what has the same name is told apart by its bytes.
NAME_BITS = 63
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of the smallest, the leftmost of equal ones (by their upper bits)."""
    bits = np.uint64(max(20, int(len(h)).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    n = len(x) - width + 1
    pad = -len(x) % width
    x = np.r_[x, np.full(pad, ~np.uint64(0))].reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).reshape(-1)
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & mask).astype(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """row, first and last window start in the row, anchor in the row, hash of the anchor, hash of the whole piece."""
    size = np.diff(offsets)
    many = np.maximum(0, size - length + 1)
    total = int(many.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = quick_prefix(data)
    h = quick_windows(sums, gram)
    row = np.repeat(np.arange(len(size)), many)
    start = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][row]
    anchor = sliding_argmin(h, length - gram + 1)[start]
    head = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(row) != 0)])
    tail = np.r_[head[1:], total] - 1
    row, first, last, anchor = row[head], start[head], start[tail], anchor[head]
    whole = mix(quick_between(sums, first, last + length) + ((last - first) * 1024 + (anchor - first)).astype(np.uint64) * _STEP)
    base = offsets[:-1][row]
    return row, first - base, last - base, anchor - base, h[anchor], whole


def pieces_by_chunk(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """The same in parts of about ``chunk`` bytes, also where a row is longer: what one part ends with begins the next."""
    for a, b in chunks(offsets, chunk):
        if offsets[b] - offsets[a] <= chunk + length:
            row, *rest = pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, gram)
            yield row + a, *rest
            continue
        at, end = int(offsets[a]), int(offsets[b])
        while at < end:
            to = min(end, at + chunk + length)
            row, first, last, anchor, h, whole = pieces(data[at:to], np.array([0, to - at]), length, gram)
            n = len(row) if to == end else len(row) - 1  # the last run may go on
            if not n:
                n = len(row)
            base = at - int(offsets[a])
            yield row[:n] + a, first[:n] + base, last[:n] + base, anchor[:n] + base, h[:n], whole[:n]
            at = end if to == end else at + (int(first[n]) if n < len(row) else to - at - length + 1)


def common_extension(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from a and from b are equal, up to ``most``: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        same = between(sums, a, a + middle) == between(sums, b, b + middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    return low


def suffix_order(data: np.ndarray, sums: np.ndarray, at: np.ndarray, end: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes data[at:end], and the common extension of each with the one before it.

    A bottom-up mergesort in which all merges of a level advance together: each element finds its place in the other run by binary
    search, and each comparison finds the first differing byte by another one over prefix hashes. With ``group``, ascending numbers,
    each group is sorted by itself, and its first suffix extends nothing.
    """
    n = len(at)
    order = np.arange(n)
    group = np.zeros(n, np.int64) if group is None else group
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else order
    size = np.diff(np.r_[head, n])
    begin, size = np.repeat(head, size), np.repeat(size, size)
    place = np.arange(n) - begin

    def below(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x is smaller than, equal to or greater than suffix y."""
        most = np.minimum(end[x] - at[x], end[y] - at[y])
        same = common_extension(sums, at[x], at[y], most)
        inside = same < most
        p, q = np.where(inside, at[x] + same, 0), np.where(inside, at[y] + same, 0)
        return np.where(inside, np.sign(data[p].astype(np.int16) - data[q]), np.sign((end[x] - at[x]) - (end[y] - at[y])))

    width = 1
    while width < size.max(initial=0):
        run = place // width
        left = run % 2 == 0
        other = begin + np.minimum(np.where(left, run + 1, run - 1) * width, size)
        low, high = other.copy(), np.minimum(other + width, begin + size)
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) >> 1
            c = below(order[todo], order[middle])
            up = (c > 0) | ((c == 0) & ~left[todo])  # equal ones of the left run come first
            low[todo] = np.where(up, middle + 1, low[todo])
            high[todo] = np.where(up, high[todo], middle)
        merged = np.empty(n, np.int64)
        merged[begin + place - run * width + low - other + (run - run % 2) * width] = order
        order = merged
        width *= 2
    x, y = order[1:], order[:-1]
    inside = group[1:] == group[:-1]
    same = np.where(inside, common_extension(sums, at[x], at[y], np.minimum(end[x] - at[x], end[y] - at[y])), 0)
    raw = data.tobytes()
    suffix = lambda k: raw[at[k] : end[k]]
    for k in np.flatnonzero(inside).tolist():
        p, q, length = suffix(order[k]), suffix(order[k + 1]), int(same[k])
        if p[:length] != q[:length] or p[length:] > q[length:] or (p[length : length + 1] or None) == q[length : length + 1]:
            break
    else:
        return order, np.r_[0, same]
    # Hashes collided: by the bytes alone.
    order = np.array(sorted(range(n), key=lambda k: (group[k], suffix(k))), np.int64)
    same = np.array([len(os.path.commonprefix([suffix(p), suffix(q)])) for p, q in zip(order[:-1], order[1:], strict=True)], np.int64)
    return order, np.r_[0, np.where(inside, same, 0)]


def repeated_windows(texts: list[bytes], anchors: np.ndarray, length: int = LENGTH, group: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """For each piece, the runs (first, last) of window starts that start a string found elsewhere among the pieces.

    A piece is the bytes of all its windows, ``anchors`` the place of its anchor in it, ``group`` (ascending) tells which share an anchor.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(size) - size
    sums = prefix(data)
    at = base + anchors
    order, lcp = suffix_order(data, sums, at, np.minimum(base + size, at + length), group)
    reach = np.zeros(len(texts), np.int64)
    reach[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    # A window from start s reaches length - (anchor - s) bytes beyond the anchor.
    first, last = np.zeros(len(texts), np.int64), np.minimum(size - length, anchors + reach - length)
    some = np.flatnonzero(last >= first)
    count = last[some] + 1
    piece = np.repeat(some, count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(piece):
        return found
    place = base[piece] + start
    # Equal windows have their anchors at the same place.
    h = mix(between(sums, place, place + length)) + (anchors[piece] - start).astype(np.uint64) * _STEP
    by = np.argsort(h, kind="stable")
    new = np.r_[True, np.diff(h[by]) != 0]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    many = np.r_[head[1:], len(by)] - head
    partner = by[head][group]
    partner = np.where(partner == by, by[np.minimum(head + 1, len(by) - 1)][group], partner)
    kept = many[group] > 1
    mate = np.empty(len(by), np.int64)
    mate[by] = np.where(kept, partner, -1)
    hit = np.flatnonzero(mate >= 0)
    if not len(hit):
        return found
    shift = place[mate[hit]] - place[hit]
    cut = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(piece[hit]) != 0) | (np.diff(shift) != 0)])
    raw = data.tobytes()
    for a, b in zip(cut.tolist(), [*(cut[1:] - 1).tolist(), len(hit) - 1], strict=True):
        x, y, p = int(place[hit[a]]), int(place[hit[b]]), int(piece[hit[a]])
        run = (int(start[hit[a]]), int(start[hit[b]]))
        other = x + int(shift[a])
        if raw[x : y + length] == raw[other : other + y - x + length]:
            found[p].append(run)
        else:  # a collision of hashes: compare every window with all of its hash
            for k in range(a, b + 1):
                mine = raw[place[hit[k]] : place[hit[k]] + length]
                like = np.flatnonzero(h == h[hit[k]])
                if any(raw[place[j] : place[j] + length] == mine for j in like if j != hit[k]):
                    found[p].append((int(start[hit[k]]),) * 2)
    return found


def _find(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces of the documents (doc, key, text): gram and name, hashes of the anchor and of the whole, and where they are."""
    name_bits = np.uint64(NAME_BITS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(2))
            ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            for row, first, last, anchor, h, whole in pieces_by_chunk(data, offsets, length, gram):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((whole >> (np.uint64(64) - name_bits)).view(np.int64)), *(pa.array(x[row]) for x in ids), *(pa.array(x.astype(np.int32)) for x in (first, last, anchor))], names=["gram", "name", "doc", "key", "first", "last", "anchor"])

    return arrow(docs, find, "gram long, name long, doc long, key long, first int, last int, anchor int")


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """Bytes of the pieces listed in column ``at`` of the documents (doc, key, text, at)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "name", "doc", "key", "first", "anchor", "piece"]
        for batch in batches:
            lists = batch.column(3)
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            parts = lists.flatten()
            gram, name, first, last, anchor = (parts.field(c).to_numpy() for c in ("gram", "name", "first", "last", "anchor"))
            raw = [t.encode("utf-8") for t in batch.column(2).to_pylist()]
            ids = [batch.column(k).to_numpy()[of] for k in range(2)]
            bounds = np.r_[0, np.cumsum(last.astype(np.int64) + length - first)]
            for a, b in chunks(bounds, 1 << 20):
                piece = [raw[k][p:q] for k, p, q in zip(of[a:b].tolist(), first[a:b].tolist(), (last[a:b] + length).tolist(), strict=True)]
                columns = (gram, name, *ids, first, anchor - first)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[a:b]) for x in columns), pa.array(piece, pa.binary())], names=names)

    return arrow(docs.select("doc", "key", "text", "at"), cut, "gram long, name long, doc long, key long, first int, anchor int, piece binary")


def _texts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Bytes of the pieces at ``places``, rows of _find(). The texts are shuffled once, at any size: the places are too many to broadcast."""
    listed = places.groupBy("doc", "key").agg(F.collect_set(F.struct("gram", "name", "first", "last", "anchor")).alias("at"))
    return _cut(docs.hint("merge").join(listed, ["doc", "key"]), length)


def _sorted(classes: DataFrame, length: int) -> DataFrame:
    """Runs (gram, name, id, first, last) of window starts found again, in the pieces (gram, name, id, n, anchor, piece) that meet by anchor.

    A piece that occurs more than once, n times, is found again as a whole.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out():
            rows = [(*r[:3], 0, len(r[5]) - length) for r in held if r[3] > 1]
            several = Counter(r[0] for r in held)
            open_ = {r[0] for r in held if r[3] == 1 and several[r[0]] > 1}
            sort = [r for r in held if r[0] in open_]
            if sort:
                group = np.cumsum([0, *(a[0] != b[0] for a, b in zip(sort, sort[1:], strict=False))])
                runs = repeated_windows([r[5] for r in sort], np.array([r[4] for r in sort], np.int64), length, group)
                rows += [(*r[:3], a, b) for r, found in zip(sort, runs, strict=True) if r[3] == 1 for a, b in found]
            if rows:
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["gram", "name", "id", "first", "last"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size > SORT_BYTES and r[0] != held[-1][0]:
                    if (x := out()) is not None:
                        yield x
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held and (x := out()) is not None:
            yield x

    return arrow(classes.select("gram", "name", "id", "n", "anchor", "piece").repartition("gram").sortWithinPartitions("gram"), settle, "gram long, name long, id long, first int, last int")


def _by_window(classes: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many different pieces for one task: windows are counted, after a count in each task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, name, id, n, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "name", "id", "n", "piece")), strict=True):
                count = len(piece) - length + 1
                two = [hashlib.blake2b(piece[k : k + length], digest_size=16).digest() for k in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(two, pa.binary()), *(pa.array([x] * count, pa.int64()) for x in (gram, name, id, n)), pa.array(range(count), pa.int32())], names=["window", "gram", "name", "id", "n", "first"])

    each = arrow(classes, cut, "window binary, gram long, name long, id long, n long, first int")
    again = each.groupBy("window").agg(F.sum("n").alias("all")).where("all > 1").select("window")
    return each.join(again, "window").select("gram", "name", "id", "first", F.col("first").alias("last"))


def _join(docs: DataFrame, finds: DataFrame, entries: int, how: str) -> DataFrame:
    return docs.join(F.broadcast(finds) if entries <= FEW else finds, ["doc", "key"], how)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc, key, runs``: window starts that begin a string found elsewhere. docs: doc, key, text."""
    found = stored(_find(docs, length, gram))
    again = stored(found.groupBy("gram").agg(F.count("*").alias("pieces")).where("pieces > 1").select("gram"))
    near = stored(join_small(found, again, "gram", "left_semi"))
    # Grouping by the bytes compares them; tasks send each different piece once.
    texts = _texts(docs, near, length).groupBy("gram", "name", "anchor", "piece").agg(F.count("*").alias("n"))
    classes = stored(texts.withColumn("id", F.monotonically_increasing_id()))
    large = stored(classes.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > SORT_PIECES).select("gram"))
    runs = _sorted(join_small(classes, large, "gram", "left_anti"), length)
    if not large.isEmpty():
        runs = runs.unionByName(_by_window(join_small(classes, large, "gram", "left_semi"), length))
    runs = stored(runs)
    # Different pieces of one name: their places are told apart by their bytes.
    twice = stored(classes.groupBy("gram", "name").agg(F.count("*").alias("n")).where("n > 1").select("gram", "name"))
    at = ["doc", "key", (F.col("p") + F.col("first")).alias("first"), (F.col("p") + F.col("last")).alias("last")]
    places, named = near.select("gram", "name", "doc", "key", F.col("first").alias("p")), runs
    if not twice.isEmpty():
        places, named = (join_small(x, twice, ["gram", "name"], "left_anti") for x in (places, runs))
    each = join_small(places, named, ["gram", "name"]).select(*at)
    if not twice.isEmpty():
        odd = _texts(docs, join_small(near, twice, ["gram", "name"], "left_semi"), length).withColumnRenamed("first", "p")
        odd = odd.join(classes.select("gram", "name", "anchor", "piece", "id"), ["gram", "name", "anchor", "piece"]).select("id", "doc", "key", "p")
        each = each.unionByName(runs.join(odd, "id").select(*at))
    each = each.groupBy("doc", "key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, first, last = merged(batch.column(2))
            offsets = np.searchsorted(of, np.arange(batch.num_rows + 1))
            runs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["first", "last"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)], names=["doc", "key", "runs"])

    return arrow(each, merge, "doc long, key long, runs array<struct<first: int, last: int>>")


def merged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs (first, last) of each list with those that touch made one: list, first, last, in order."""
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    runs = lists.flatten()
    first, last = (runs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last"))
    order = np.lexsort((first, of))
    of, first, last = of[order], first[order], last[order]
    far = np.maximum.accumulate((of << 32) + last)  # the end of all runs so far of the same list
    head = np.flatnonzero(np.r_[True, (of << 32)[1:] + first[1:] > far[:-1] + 1]) if len(of) else order
    return of[head], first[head], far[np.r_[head[1:], len(of)] - 1] - (of[head] << 32) if len(of) else last


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, kept, removed``.

    Texts are UTF-8 bytes, null is empty. Every byte is removed that is covered by a string of ``length`` bytes which also starts
    anywhere else, in the same document or another, judged on the input. ``kept`` holds the bytes that remain, ``removed`` the maximal
    removed runs (start, end). Each row is a document, equal rows and rows with one id too, and those with a null id; a text is
    read in parts, however long it is. No rows give no rows, other columns are left out.
    """
    whole = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = whole.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("key", F.xxhash64("doc_id", "text"))
    finds = stored(repeats(keyed.where(F.octet_length("text") >= length).select("doc", "key", "text"), length, gram))
    entries = finds.agg(F.sum(F.size("runs"))).first()[0] or 0
    both = _join(keyed, finds, entries, "left").select("doc_id", "text", F.expr("transform(array_sort(runs), r -> r.first)").alias("first"), F.expr("transform(array_sort(runs), r -> r.last)").alias("last"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, kept, removed = [], [], []
            for t, first, last in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = t.encode("utf-8")
                gone: list[list[int]] = []
                for a, b in zip(first or (), last or (), strict=True):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b + length)
                    else:
                        gone.append([a, b + length])
                size.append(len(raw))
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(raw)], strict=True)))
                removed.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "removed"])

    return arrow(both, take, f"doc_id {whole.schema['doc_id'].dataType.simpleString()}, n_bytes long, kept binary, removed array<struct<start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
