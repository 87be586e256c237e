import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffixes as S
from tessera.llm.hashing import prefix


def brute(rows, n):
    seen = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 400))) for _ in range(25)]
    part = lambda b: b[rng.randint(0, len(b)) :][: rng.randint(1, 200)] if rng.random() < 0.5 else b
    rows = []
    for k in range(150):
        t = "".join(part(rng.choice(base)) if rng.random() < 0.6 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(0, 5)))
        rows.append((k, "a" * rng.randint(0, 300) if rng.random() < 0.05 else t))
    return rows + [(500, None), (501, ""), (502, "ab" * 30_000), (None, rows[5][1]), (7, rows[7][1]), (8, "another text under an id that is taken")]


def run(spark, rows, n=40, gram=10):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in S.digest(S.deduplicate(frame, length=n, gram=gram)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = case(seed)
    assert run(spark, rows) == brute(rows, 40)


def test_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(S, "SORT_PIECES", 1)
    rows = case(3)
    assert run(spark, rows) == brute(rows, 40)


def test_suffix_order():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    order, lcp = S.suffix_order(data, prefix(data), start, start + size)
    assert [texts[k] for k in order] == sorted(texts)
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("bits", [1, 8])
def test_names_that_collide(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "NAME_BITS", bits)
    rows = case(4)
    assert run(spark, rows) == brute(rows, 40)


def test_long_texts_in_parts():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(n)) for n in (0, 39, 5000, 40, 300, 1500)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = S.pieces(data, offsets, 40, 10)
    parts = [np.concatenate(x) for x in zip(*S.pieces_by_chunk(data, offsets, 40, 10, 100), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_order_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(S, "between", lambda sums, start, end: (end - start).astype(np.uint64))
    texts = ["abc", "abd", "ab", "b", "abcd"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    order, lcp = S.suffix_order(data, prefix(data), start, start + size)
    assert [texts[k] for k in order] == sorted(texts) and lcp.tolist() == [0, 2, 3, 2, 0]


def test_groups_are_sorted_by_themselves():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    group = np.sort(np.array([rng.choice([0, 3, 4, 5, 5, 5, 8]) for _ in texts]))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    order, lcp = S.suffix_order(data, prefix(data), start, start + size, group)
    assert [(group[k], texts[k]) for k in order] == sorted(zip(group, texts, strict=True))
    assert all(lcp[k] == 0 for k in range(len(order)) if k == 0 or group[order[k]] != group[order[k - 1]])


def test_merged_runs():
    import pyarrow as pa

    lists = [[(3, 5), (6, 9), (20, 20)], [], [(1, 100), (4, 5), (101, 102), (104, 104)], [(0, 0)]]
    column = pa.array([[{"first": a, "last": b} for a, b in reversed(x)] for x in lists], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
    want = [(0, 3, 9), (0, 20, 20), (2, 1, 102), (2, 104, 104), (3, 0, 0)]
    assert list(zip(*(x.tolist() for x in S.merged(column)), strict=True)) == want
    assert all(len(x) == 0 for x in S.merged(column.slice(1, 1)))
