"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Cells alone would lose pairs that lie on either side of a border. A vector therefore also visits every cell in which a
vector within reach could be at home: with d the largest distance of two linked unit vectors, x can only
have a partner at home with centre b if it is no farther than d from the plane between b and its own centre a,
that is x(a - b) <= d |a - b|. So no link is lost, whatever the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, arrow, join_small, stored
from tessera.llm.components import connected

COSINE = 0.93
#: Vectors a cell is meant for; centres altogether and of one label; sampled vectors a centre is fitted on; rounds.
CELL, CENTRES, LABEL_CENTRES, SAMPLE, ROUNDS = 2000, 50_000, 4096, 32, 8
#: Left rows a task holds, and right rows it multiplies with them at a time.
BLOCK, STRIP = 2048, 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit vectors; an empty cell moves to the vector that is farthest from its own centre."""
    centre = x[np.random.RandomState(5).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        like = x @ centre.T
        home = like.argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        far = iter(np.argsort(like.max(axis=1)))
        for c in np.flatnonzero(size < 1e-12):
            total[c], size[c] = x[next(far)], 1.0
        centre = total / size[:, None]
    return centre


def visits(x: np.ndarray, centre: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and which cells (home included) it must be compared in."""
    like = x @ centre.T
    home = like.argmax(axis=1)
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centre @ centre.T))
    return home, like[np.arange(len(x)), home][:, None] - like <= reach * apart[home] + 1e-12


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _centres(reps: DataFrame, cell: int) -> dict[str, np.ndarray]:
    """Centres of each group with more vectors than a cell, fitted on a sample of SAMPLE vectors a centre."""
    total = reps.count()
    cell = max(cell, -(-total // CENTRES))
    large = {r.grp: min(LABEL_CENTRES, -(-r.n // cell)) for r in reps.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > cell).collect()}  # CENTRES rows at most
    if not large:
        return {}
    shared = reps.sparkSession.sparkContext.broadcast(large)
    names = reps.sparkSession.createDataFrame([(g, k) for g, k in large.items()], "grp string, k int")
    counts = reps.groupBy("grp").agg(F.count("*").alias("n"))
    rate = counts.join(F.broadcast(names), "grp").select("grp", (F.col("k") * SAMPLE / F.col("n")).alias("rate"))
    sample = reps.join(F.broadcast(rate), "grp").where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 20)) < F.col("rate") * (1 << 20))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for g, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(g, []).append(np.array(v, np.float64))
        for g, rows in held.items():
            centre = spherical_kmeans(unit(np.vstack(rows)), shared.value[g])
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([centre.shape[1]], pa.int32()), pa.array([centre.tobytes()], pa.binary())], names=["grp", "dim", "centre"])

    rows = arrow(sample.select("grp", "vector").repartition("grp"), fit, "grp string, dim int, centre binary").collect()
    return {r.grp: np.frombuffer(r.centre).reshape(-1, r.dim) for r in rows}


def near_duplicates(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label and length link when their cosine in double precision is at least ``cosine`` (above 0). Vectors
    that are null, zero or hold null or non-finite components, and those with a null label or id, link with nothing and
    are kept. Equal vectors are compared once for all; rows with one id are vectors of their own.
    """
    own = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    keyed = own.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("grp", F.when(F.col("good"), F.concat_ws(":", F.col("label").cast("string"), F.size("vector"))))
    keyed = keyed.withColumn("h1", F.when(F.col("good"), F.xxhash64("grp", "vector"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(11), F.reverse("vector"), "grp")))
    # Spherical cells and the products need no lengths, so scaling to the largest component avoids overflow.
    scaled = F.transform("vector", lambda x: x / F.array_max(F.transform("vector", F.abs)))
    # A different vector goes by a number of its own, as ids may come twice.
    reps = keyed.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("grp").alias("grp"), F.first("vector").alias("vector"))
    reps = stored(reps.withColumn("vector", scaled).withColumn("rep", F.monotonically_increasing_id()))
    shared = vectors.sparkSession.sparkContext.broadcast(_centres(reps, cell))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell to be compared in."""
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), dtype=object)
            lists = batch.column(3)
            for g in dict.fromkeys(groups):
                at = np.flatnonzero(groups == g)
                own = lists.take(pa.array(at))
                if (centre := shared.value.get(g)) is None:
                    row, where, home = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                else:
                    home, near = visits(unit(_vectors(own)), centre, cosine)
                    row, where = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[row])), pa.array([g] * len(row)), batch.column(2).take(pa.array(at[row])), own.take(pa.array(row)), pa.array(where.astype(np.int32)), pa.array(home[row] == where)], names=["rep", "grp", "n", "vector", "cell", "home"])

    placed = stored(arrow(reps.select("rep", "grp", "n", "vector"), place, "rep long, grp string, n long, vector array<double>, cell int, home boolean"))
    sizes = stored(placed.groupBy("grp", "cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("blocks")))
    few = sizes.count() <= BROADCAST_ROWS
    each = placed.join(F.broadcast(sizes) if few else sizes, ["grp", "cell"])
    # Left rows of a cell are dealt out over its blocks; every row of the cell is a right row of each block.
    left = each.where("home").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("side", F.lit(0))
    right = each.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    found = stored(arrow(left.unionByName(right).select("grp", "cell", "block", "side", "rep", "n", "vector").repartition("grp", "cell", "block").sortWithinPartitions("grp", "cell", "block", "side", "rep"), _compare(cosine), "u long, v long, links long"))
    comps = stored(connected(found.where("v is not null").select("u", "v")).toDF("rep", "comp"))
    least = join_small(reps.select("rep", "first"), comps, "rep").groupBy("comp").agg(F.min("first").alias("component"))
    comps = comps.join(least, "comp").select("rep", "component")
    links = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    classes = stored(reps.select("h1", "h2", "rep", "first", "n").join(links.withColumnRenamed("u", "rep"), "rep", "left").join(comps, "rep", "left").where("n > 1 or links > 0"))
    out = join_small(keyed.select("vec_id", F.struct("h1", "h2").alias("h")), classes.select(F.struct("h1", "h2").alias("h"), "first", "n", "links", "component"), "h", "left")
    component = F.coalesce("component", "first", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _compare(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, strip = None, [], []
        matrix = None

        def multiply():
            nonlocal matrix
            if not held or not strip:
                return None
            if matrix is None:
                ids, _, x = zip(*held, strict=True)
                x = np.array(x, np.float64)
                matrix = np.array(ids), x, np.linalg.norm(x, axis=1)
            ids, x, size = matrix
            other, n, y = zip(*strip, strict=True)
            other, n, y = np.array(other), np.array(n), np.array(y, np.float64)
            linked = (x @ y.T) / (size[:, None] * np.linalg.norm(y, axis=1)[None, :]) >= cosine
            linked &= ids[:, None] != other[None, :]
            links = linked @ n
            some = np.flatnonzero(links)
            if not len(some):
                return None
            u, v = [], []
            fresh, unseen = linked.any(axis=0), np.zeros(len(ids), bool)
            unseen[some] = True
            for seed in some:
                queue = [seed] if unseen[seed] else []
                unseen[seed] = False
                while queue:
                    a = queue.pop()
                    for b in np.flatnonzero(linked[a] & fresh):
                        fresh[b] = False
                        u.append(ids[a])
                        v.append(other[b])
                        more = np.flatnonzero(linked[:, b] & unseen)
                        unseen[more] = False
                        u.extend(ids[more])
                        v.extend([other[b]] * len(more))
                        queue.extend(more)
            none = [None] * len(some)
            return pa.RecordBatch.from_arrays([pa.array([*map(int, u), *ids[some].tolist()], pa.int64()), pa.array([*map(int, v), *none], pa.int64()), pa.array([None] * len(u) + links[some].astype(np.int64).tolist(), pa.int64())], names=["u", "v", "links"])

        for batch in batches:
            rows = batch.to_pydict()
            for key, side, row in zip(zip(rows["grp"], rows["cell"], rows["block"], strict=True), rows["side"], zip(rows["rep"], rows["n"], rows["vector"], strict=True), strict=True):
                if key != now:
                    if (out := multiply()) is not None:
                        yield out
                    now, held, strip, matrix = key, [], [], None
                if not side:
                    held.append(row)
                    continue
                strip.append(row)
                if len(strip) == STRIP:
                    if (out := multiply()) is not None:
                        yield out
                    strip = []
        if (out := multiply()) is not None:
            yield out

    return compare
