import numpy as np
import pytest

from tessera.llm import embeddings as E


def brute(rows, cosine=0.93):
    good = [(k, v, lab) for k, v, lab in rows if k is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = [np.array(v, float) for _, v, _ in good]
    links = {i: set() for i in range(len(good))}
    for i in range(len(good)):
        for j in range(i):
            if good[i][2] == good[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= cosine:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in range(len(good)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(good[j][0] for j in seen)
    out = [(good[i][0], len(links[i]), comp[i], good[i][0] == comp[i]) for i in links]
    rest = [r for r in rows if not any(r is g for g in ())]
    ids = [g[0] for g in good]
    return sorted(out + [(k, 0, k, True) for k, v, lab in rest if k not in ids], key=repr)


def case(seed, n=400, dim=8):
    rng = np.random.RandomState(seed)
    centre = rng.normal(size=(30, dim))
    x = (centre[rng.randint(0, 30, n)] + rng.normal(size=(n, dim)) * rng.choice([0.01, 0.15, 0.4], n)[:, None]).astype(np.float32)
    x[20:40] = x[20]
    rows = [(int(k), [float(y) for y in v], int(k % 3)) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, [None] * dim, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [float("inf")] + [1.0] * (dim - 1), 0), (1008, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("cell", [2000, 20])
def test_brute_force(spark, cell):
    rows = case(3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    found = sorted((tuple(r) for r in E.near_duplicates(frame, cell=cell).collect()), key=repr)
    assert found == brute(rows)
    assert sum(r[1] for r in found) > 1000


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)
    monkeypatch.setattr(E, "STRIP", 50)
    rows = case(4)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert sorted((tuple(r) for r in E.near_duplicates(frame).collect()), key=repr) == brute(rows)


def test_visits_lose_no_pair():
    rng = np.random.RandomState(1)
    x = E.unit(rng.normal(size=(600, 5)))
    centre = E.spherical_kmeans(x, 12)
    home, near = E.visits(x, centre, 0.93)
    for i, j in np.argwhere(np.triu(x @ x.T >= 0.93, 1)):
        assert near[j, home[i]] and near[i, home[j]]


def test_different_vectors_of_one_id(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [1.0, 0.01], 1), (7, [0.0, 1.0], 1), (9, [0.0, 2.0], 1), (3, [0.01, 1.0], 1)]
    found = sorted((tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    assert found == brute(rows)
    assert found == [(3, 2, 3, True), (7, 1, 7, True), (7, 1, 7, True), (7, 2, 3, False), (9, 2, 3, False)]


def test_repeated_rows_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]
    found = sorted(tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
