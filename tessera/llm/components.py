"""Distributed union-find, and the exact comparison of candidates that it brought together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow, join_small, stored

#: A group that one task compares: members, and bytes of their texts. Larger groups are compared block by block.
GROUP_ROWS, GROUP_BYTES = 2000, 8 << 20
#: Pairs of groups up to this size are compared one by one, behind a suffix filter.
FEW = 8
#: In groups up to this size sets are met by all their members, in larger ones by the rarest.
WHOLE = 100
#: Members of a group that stand for it when groups of a large component are compared.
HEADS = 4
#: Buckets of candidate keys at least, bytes that one is meant for, entries from which a bucket is settled in part, and bytes that a task packs at once.
BUCKETS, BUCKET_BYTES, FULL, PACK_BYTES = 1024, 8 << 20, 1 << 20, 8 << 20
#: Edges that one task makes components of; more go in rounds.
ONE_TASK = 300_000
#: Nodes of one key up to which all their pairs are filtered at once.
PAIRED = 64
#: Sketched nodes of one key that are linked as a chain where a bucket is settled in part.
CHAINED = 1 << 14
#: Pairs that are filtered at once.
PAIRS = 1 << 16
_PIVOTS = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)


class Forest:
    """Union-find that keeps the smallest member as root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as stars: (member, smallest member)."""
    forest, kind = Forest(), pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != b:
                forest.join(a, b)
    yield from stars(forest, kind)


def stars(forest: Forest, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    nodes = list(forest.up)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array(list(map(forest.find, part)), kind)], names=["u", "v"])


def _compressed(hooks: DataFrame) -> DataFrame:
    """hooks (u, v), a v for each u and v < u: v becomes the root, by doubling."""
    while True:
        above = hooks.select(F.col("u").alias("v"), F.col("v").alias("w"))
        step = stored(hooks.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")))
        hooks = step.select("u", "v")
        if step.where("moved").isEmpty():
            return hooks


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of the edges (two columns of one type, any direction); a component is its smallest node.

    Every node hooks to its smallest neighbour, hooks are shortened to roots, and edges between different roots go on, which
    each task replaces by stars; each round leaves fewer. Once ONE_TASK are left, a task ends it. No edge leaves the executors. Null ends are no
    edges. Edges come best as the forests of the tasks that found them.
    """
    kind = edges.schema[0].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    left = edges.toDF("u", "v").where("u is not null and v is not null and u <> v")
    left = stored(left.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    labels = None
    while many := left.count():
        last = many <= ONE_TASK
        hooks = stored(arrow(left.repartition(1), forest_of, schema)) if last else _compressed(stored(left.groupBy("u").agg(F.min("v").alias("v"))))
        root = hooks.select(F.col("u").alias("v"), F.col("v").alias("w"))
        labels = hooks if labels is None else stored(labels.join(root, "v", "left").select("u", F.coalesce("w", "v").alias("v")).unionByName(hooks))
        if last:
            break
        a = left.join(hooks.select("u", F.col("v").alias("x")), "u").join(root, "v", "left").select("x", F.coalesce("w", "v").alias("y")).where("x <> y")
        left = stored(arrow(a.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")), forest_of, schema))
    if labels is None:
        labels = left
    return labels.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(labels.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<u4"), ("at", "<u4")])
#: With 64 parities of the set's members, dealt by their hashes.
SKETCHED = np.dtype([*ENTRY.descr, ("sketch", "<u8")])


def buckets_for(entries: int, size: int = ENTRY.itemsize) -> int:
    """Into how many buckets so many entries go."""
    return max(BUCKETS, -(-entries * size // BUCKET_BYTES))


class Packer:
    """Entries (key, node) and, with ``sized``, (n, at), with ``sketched`` (n, at, sketch) as rows (bucket, block): a block holds a task's entries of one range of keys.

    A row for each entry would cost more than all else that is done with it.
    """

    def __init__(self, buckets: int, sized: bool = False, sketched: bool = False):
        self.buckets, self.kind = np.uint64(buckets), SKETCHED if sketched else ENTRY if sized else np.dtype(ENTRY.descr[:2])
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, key: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = np.empty(len(key), self.kind)
        for name, x in zip(self.kind.names, (key, *rest), strict=True):
            part[name] = x
        self.parts.append(part)
        self.held += part.nbytes
        if self.held > PACK_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        every = np.concatenate(self.parts)
        self.parts, self.held = [], 0
        where = _bucket(every["key"], self.buckets)
        order = np.argsort(where, kind="stable")
        every, where = every[order], where[order]
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        ends = (np.r_[first, len(every)] * self.kind.itemsize).astype(np.int64)
        blocks = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(every.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(where[first].astype(np.int32)), blocks], names=["bucket", "block"])


def _bucket(key: np.ndarray, buckets: np.uint64) -> np.ndarray:
    return ((key >> np.uint64(32)) * buckets >> np.uint64(32)).astype(np.int64)


def may_link(x: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs of sized entries x[a], x[b] of one key the filters by length, by place and, where there are sketches, by sketch let pass.

    Two sets differ in at least as many members as their sketches in parities.
    """
    n, m = x["n"][a].astype(np.int64), x["n"][b].astype(np.int64)
    need = -(-num * (n + m) // (num + den))
    kept = (np.minimum(n - x["at"][a], m - x["at"][b]) >= need) & (np.minimum(n, m) * den >= num * np.maximum(n, m))
    if "sketch" in x.dtype.names:
        kept &= n + m - np.bitwise_count(x["sketch"][a] ^ x["sketch"][b]) >= 2 * need
    return kept


def small_groups(x: np.ndarray, first: np.ndarray, size: int, num: int, den: int) -> Iterator[np.ndarray]:
    """Edges of the groups of one size that start at ``first``: pairs that may_link() lets pass."""
    i, j = np.triu_indices(size, 1)
    step = max(1, PAIRS // len(i))
    for k in range(0, len(first), step):
        start = first[k : k + step, None]
        a, b = (start + i).reshape(-1), (start + j).reshape(-1)
        kept = np.flatnonzero(may_link(x, a, b, num, den))
        yield _different(np.column_stack([x["node"][a[kept]], x["node"][b[kept]]]))


def large_group(x: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    """Edges that connect what all pairs that may_link() lets pass would, of one group, sorted by size: what is reached is not asked for again."""
    n, fresh = x["n"].astype(np.int64), np.ones(len(x), bool)
    least, most = np.searchsorted(n, -(-num * n // den)), np.searchsorted(n, den * n // num, side="right")
    for seed in range(len(x)):
        queue = [seed] if fresh[seed] else []
        fresh[seed] = False
        while queue:
            a = queue.pop()
            others = least[a] + np.flatnonzero(fresh[least[a] : most[a]])
            if len(others) and len(others := others[may_link(x, a, others, num, den)]):
                fresh[others] = False
                queue += others.tolist()
                yield np.column_stack([np.full(len(others), x["node"][a]), x["node"][others]])


def _different(edges: np.ndarray) -> np.ndarray:
    """The rows (u, v), each once."""
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    return edges[np.r_[True, (edges[1:] != edges[:-1]).any(axis=1)]] if len(edges) else edges


def bucket_edges(rows: DataFrame, num: int = 0, den: int = 1, sketched: bool = False) -> DataFrame:
    """Candidate edges (u, v) from a Packer's rows (bucket, block): nodes that share a key, as forests.

    With num / den over 0 entries are sized: n is a node's set size and ``at`` the key's place in the set's order. Pairs of nodes that
    share a key are then filtered by length and place; where a key has over PAIRED nodes, neighbours by size whose lengths
    agree are linked instead, which connects at least what all their pairs would. With ``sketched`` all pairs are filtered, by sketch too,
    and only keys with over CHAINED nodes are linked by neighbours, in buckets that are settled in part.
    """
    sized = bool(num)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        kind = SKETCHED if sketched else ENTRY if sized else np.dtype(ENTRY.descr[:2])
        held: list[np.ndarray] = []
        size, now, large = 0, None, np.zeros(0, np.uint64)

        def join(edges: np.ndarray) -> None:
            for a, b in _different(edges).tolist():
                forest.join(a, b)

        def settle(last: bool) -> None:
            """Joins what the held entries of a bucket say. Before the bucket's end only keys with many nodes are settled, of which one node for each size goes on."""
            nonlocal held, size, large
            x = np.concatenate(held)
            x = x[np.lexsort((x["n"], x["key"]) if sized else (x["key"],))]
            key, node = x["key"], x["node"]
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            many = np.diff(np.r_[first, len(x)])
            chained = many > 1
            if sized:
                chained = np.isin(key[first], large) | (many > (CHAINED if sketched else PAIRED)) & (not (sketched and last))
            inside = np.repeat(chained, many)
            linked = np.flatnonzero(inside[1:] & ~new[1:] & (node[1:] != node[:-1]))
            if sized:
                n = x["n"].astype(np.int64)
                linked = linked[n[linked] * den >= num * n[linked + 1]]
            join(np.column_stack([node[linked], node[linked + 1]]))
            if last:
                if sized:
                    found = [np.zeros((0, 2), np.int64)]
                    for k in np.flatnonzero(np.bincount(many[~chained & (many <= PAIRED)], minlength=3)[2:]) + 2:
                        found += small_groups(x, first[~chained & (many == k)], int(k), num, den)
                    for k in np.flatnonzero(~chained & (many > PAIRED)):
                        found += large_group(x[first[k] : first[k] + many[k]], num, den)
                    join(np.concatenate(found))
                held, size, large = [], 0, np.zeros(0, np.uint64)
            else:
                large = np.union1d(large, key[first[chained]]) if sized else large
                x = x[~inside | new | (np.r_[True, x["n"][1:] != x["n"][:-1]] if sized else False)]
                held, size = [x], len(x)

        top = FULL
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    if held:
                        settle(True)
                    now, top = bucket, FULL
                held.append(np.frombuffer(block.as_buffer(), kind))
                size += len(held[-1])
                if size > top:
                    settle(False)
                    top = max(FULL, 2 * size)
        if held:
            settle(True)
        yield from stars(forest, pa.int64())

    return arrow(rows.select("bucket", "block").repartition("bucket").sortWithinPartitions("bucket"), pairs, "u long, v long")


def links_within(sets: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links that connect what all links (intersection / union >= num / den) would connect; sets are sorted, without repeats or empty ones.

    num is over 0. Each pair is looked at once at most, and not at all where both are connected already or share none of their rarest members.
    """
    m, size = len(sets), np.array([len(s) for s in sets], np.int64)
    if m <= FEW:
        forest = Forest()
        parts = [np.diff(np.r_[0, np.searchsorted(s, _PIVOTS), len(s)]) for s in sets]
        for a in range(m):
            for b in range(a + 1, m):
                need = -(-num * (size[a] + size[b]) // (num + den))
                if min(size[a], size[b]) >= need and np.minimum(parts[a], parts[b]).sum() >= need and forest.find(a) != forest.find(b):
                    if len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= need:
                        forest.join(a, b)
                        yield a, b
        return
    _, token, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    tokens, starts, of = len(met), np.r_[0, np.cumsum(size)], np.repeat(np.arange(m), size)
    head = size
    if m > WHOLE:  # two sets that link share one of the first size - ceil(size * num / den) + 1 of either, the rarest
        rank = np.empty(tokens, np.int64)
        rank[np.argsort(met, kind="stable")] = np.arange(tokens)
        token = np.sort(of * tokens + rank[token]) - of * tokens
        head = size + num * size // -den + 1
    listed = np.flatnonzero(np.arange(len(token)) - starts[of] < head[of])
    owner = of[listed[np.argsort(token[listed], kind="stable")]]
    first = np.r_[0, np.cumsum(np.bincount(token[listed], minlength=tokens))]
    rest, fresh, mark = size - head, np.ones(m, bool), np.zeros(tokens, bool)

    def among(start: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.repeat(start - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())

    for seed in range(m):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        queue = [seed]
        while queue and fresh.any():
            a = queue.pop()
            mine = token[starts[a] : starts[a] + head[a]]
            shared = np.bincount(owner[among(first[mine], first[mine + 1] - first[mine])], minlength=m)
            need = -(-num * (size + size[a]) // (num + den))
            # Of the two heads one ends first; what is in common beyond it is beyond that set's head.
            others = np.flatnonzero(fresh & (shared > 0) & (shared + np.maximum(rest, rest[a]) >= need) & (np.minimum(size, size[a]) >= need))
            if not len(others):
                continue
            if m > WHOLE:
                mark[token[starts[a] : starts[a + 1]]] = True
                common = np.add.reduceat(mark[token[among(starts[others], size[others])]], np.r_[0, np.cumsum(size[others])[:-1]], dtype=np.int64)
                mark[token[starts[a] : starts[a + 1]]] = False
                others = others[common >= need[others]]
            fresh[others] = False
            for b in others.tolist():
                queue.append(b)
                yield a, b


def _blocks_of(rows: int, size: int):
    return F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("weight") / size)).cast("long")


def blocks(nodes: DataFrame) -> DataFrame:
    """``node, comp, i, j``: where each of the nodes (node, comp, weight) is compared; with every other of its component once at least."""
    large = stored(nodes.groupBy("comp").agg(_blocks_of(GROUP_ROWS, GROUP_BYTES).alias("blocks")).where("blocks > 1"))
    spread = join_small(nodes, large, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    return spread.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("node", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with ``label``, the component of the edges that each is in."""
    found = stored(connected(edges).toDF("node", "label"))
    return stored(join_small(nodes.drop("label"), found, "node", "left").withColumn("label", F.coalesce("label", "node")))


def links(nodes: DataFrame, members: Callable[[DataFrame], DataFrame], compare: Callable[[list, list], Iterator[tuple[int, int]]]) -> DataFrame:
    """Edges (u, v) that connect what all true links among the nodes (node, comp, weight; stored) of each candidate component would connect.

    ``members`` gives rows (node, comp, i, j) the ``text`` by which ``compare`` finds links among a list of nodes, as pairs of places. A component that fits a task is compared there. A larger one is cut into blocks that are
    compared by themselves; then HEADS of each group of twice as many that this found are compared with each other; what is still apart from
    the largest group after that is compared with that group and, each pair once, with each other. Copies of one text, the groups that get
    large, are together after the first two steps, each linear in their number; only what is apart costs its number times the component's.
    """
    large = stored(nodes.groupBy("comp").agg(_blocks_of(GROUP_ROWS, GROUP_BYTES).alias("blocks"), F.count("*").alias("n")).where("blocks > 1"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    once = join_small(nodes, large, "comp", "left").withColumn("i", F.coalesce(block, F.lit(0)).cast("long"))
    edges = stored(verified(members(once.select("node", "comp", "i", F.col("i").alias("j"))), compare))
    if large.isEmpty():
        return edges
    spread = _labelled(join_small(nodes, large.select("comp"), "comp", "left_semi"), edges)
    first = F.array_distinct(F.array(*(F.min_by(F.struct("node", "weight"), F.xxhash64("node", F.lit(k))) for k in range(HEADS))))
    heads = spread.groupBy("comp", "label").agg(first.alias("h"), F.count("*").alias("n")).where(F.col("n") >= 2 * HEADS)
    heads = stored(heads.select("comp", F.explode("h").alias("h")).select("comp", "h.node", "h.weight"))
    edges = stored(edges.unionByName(verified(members(blocks(heads)), compare)))
    spread = _labelled(spread, edges)
    main = spread.groupBy("comp", "label").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    spread = stored(join_small(spread, stored(main), "comp").withColumn("apart", F.col("label") != F.col("main")))
    half = _blocks_of(GROUP_ROWS // 2 or 1, GROUP_BYTES // 2)
    sizes = stored(spread.where("apart").groupBy("comp").agg(half.alias("k")).join(spread.where("not apart").groupBy("comp").agg(half.alias("m")), "comp"))
    if sizes.isEmpty():
        return edges
    each = join_small(spread, sizes, "comp")
    place = lambda k, c: F.pmod(F.xxhash64("node", F.lit(k)), F.col(c))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    # Places below 0 are of those apart with the largest group, others of those apart with each other.
    asked = each.where("apart").withColumn("j", upto("m")).select("node", "comp", (-1 - place(1, "k")).alias("i"), "j")
    against = each.where("not apart").withColumn("i", upto("k")).select("node", "comp", (-1 - F.col("i")).alias("i"), place(2, "m").alias("j"))
    among = blocks(spread.where("apart").select("node", "comp", "weight"))
    return edges.unionByName(verified(members(asked.unionByName(against).unionByName(among)), compare))


def by_sets(sets: Callable[[list, list], list[np.ndarray]], num: int, den: int) -> Callable[[list, list], Iterator[tuple[int, int]]]:
    """Compares by links_within(); ``sets`` turns nodes and their texts into sorted sets. Empty ones link with nothing."""

    def compare(nodes: list, texts: list) -> Iterator[tuple[int, int]]:
        found = [(k, s) for k, s in enumerate(sets(nodes, texts)) if len(s)]
        if len(found) > 1:
            for a, b in links_within([s for _, s in found], num, den):
                yield found[a][0], found[b][0]

    return compare


def verified(members: DataFrame, compare: Callable[[list, list], Iterator[tuple[int, int]]]) -> DataFrame:
    """Edges (u, v) of true links among members (comp, i, j, node, text) that meet, as forests."""
    kind = members.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node, text = None, [], []

        def out():
            if edges := [(node[a], node[b]) for a, b in compare(node, text)]:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type_) for x in zip(*edges, strict=True)], names=["u", "v"])

        for batch in batches:
            type_ = batch.column(3).type
            for key, x, t in zip(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key != now:
                    if len(node) > 1:
                        yield from out()
                    now, node, text = key, [], []
                node.append(x)
                text.append(t or "")
        if len(node) > 1:
            yield from out()

    return arrow(members.select("comp", "i", "j", "node", "text").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node"), run, f"u {kind}, v {kind}")
