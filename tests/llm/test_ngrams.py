import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import components as C
from tessera.llm import ngrams as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {65 + k: 97 + k for k in range(26)}


def sets(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    every = [(d, sets(t, n)) for d, t in rows]
    up = {d: d for d, _ in every if d is not None}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, (a, x) in enumerate(every):
        for b, y in every[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(x), None if d is None else find(d) if x else d) for d, x in every), key=repr)


def case(seed):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(400)] + ["The", "the", "É"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage = text(30)
    rows = []
    for g in range(25):
        base = text(rng.choice([0, 1, 2, 3, 9, 40, 120, 200]))
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 8])):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "x " * 30_000), (2004, "x " * 30_001), (None, rows[0][1]), (rows[4][0], rows[4][1])]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 1, 2)])
def test_brute_force(spark, n, num, den):
    rows = case(n)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("n", F.lit("clash"))
    found = sorted((tuple(r) for r in N.near_duplicates(frame, n=n, num=num, den=den).collect()), key=repr)
    assert found == brute(rows, n, num, den)


def test_large_groups_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP_ROWS", 5)
    rng = random.Random(8)
    base = ["w%d" % rng.randrange(5000) for _ in range(150)]
    rows = []
    for k in range(40):
        w = base[:]
        w[k * 3] = "changed%d" % k
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((tuple(r) for r in N.near_duplicates(frame).collect()), key=repr)
    assert found == brute(rows, 3, 90, 100) and {r[2] for r in found} == {0}


@pytest.mark.parametrize("rows_of_a_group", [3, 8])
def test_links_of_large_components(spark, monkeypatch, rows_of_a_group):
    """All of one candidate component: copies in a few groups, some of them linked by one pair only, and texts that link with nothing."""
    monkeypatch.setattr(C, "GROUP_ROWS", rows_of_a_group)
    rng = random.Random(6)
    sets = []
    for _ in range(4):
        base = rng.sample(range(300), 20)
        for _ in range(rng.choice([6, 12])):
            sets.append({*base[:-2], *rng.sample(range(300), 2)} if rng.random() < 0.7 else set(base))
    chain = rng.sample(range(300), 20)
    for k in range(12):
        chain = [*chain[1:], 1000 + k]
        sets.append(set(chain))
    sets += [set(rng.sample(range(2000, 3000), 20)) for _ in range(6)]
    texts = [" ".join(map(str, sorted(x))) for x in sets]
    nodes = spark.createDataFrame([(k, k % 2 if k > 60 else 0, 20) for k in range(len(sets))], "node long, comp long, weight long")
    words = spark.createDataFrame(list(enumerate(texts)), "node long, text string")

    def of(_, lines):
        import numpy as np

        return [np.unique(np.array([int(w) for w in t.split()], np.uint64)) for t in lines]

    found = C.connected(C.links(nodes, lambda where: words.join(where, "node"), C.by_sets(of, 80, 100))).collect()
    comp = {r.node: r.component for r in found}
    for a, x in enumerate(sets):
        seen, todo = {a}, [a]
        while todo:
            c = todo.pop()
            for b, y in enumerate(sets):
                if b not in seen and (b % 2 if b > 60 else 0) == (c % 2 if c > 60 else 0) and 100 * len(sets[c] & y) >= 80 * len(sets[c] | y):
                    seen.add(b)
                    todo.append(b)
        assert comp.get(a, a) == min(seen)


@pytest.mark.parametrize("one_task", [0, 40, 300_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)] + [(None, 3), (4, None), (6, 6)]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in C.connected(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert found == {a: find(a) for a in list(up)}
    assert C.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def packed(rows, sized, buckets=3):
    def pack(batches):
        packer = C.Packer(buckets, sized)
        for b in batches:
            yield from packer.add(*(b.column(k).to_numpy() for k in range(b.num_columns)))
        yield from packer.flush()

    return rows.mapInArrow(pack, "bucket int, block binary")


def test_rest_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(C, "PACK_BYTES", 1 << 16)
    # the entries come in parts of which the last has 20 or so; by their places alone no two of them would be candidates
    rows = spark.range(0, 1_200_020, 1, 1).selectExpr("1L as key", "id as node", "10L as n", "9L as at")
    found = C.bucket_edges(packed(rows, True), 90, 100)
    assert found.select("u").distinct().count() == 1_200_019 and found.select("v").distinct().collect()[0].v == 0


def test_buckets_of_all_sizes(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60) << 57, rng.randrange(400), n := rng.randint(5, 40), rng.randrange(n)) for _ in range(3000)]
    rows = [(k, v, 10 + v % 30, at % 10) for k, v, _, at in rows if k % (7 << 57) or rng.random() < 0.1]
    want = {}

    def find(up, a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    by_key = {}
    for k, v, n, at in rows:
        by_key.setdefault(k, []).append((n, v, at))
    for sized in (False, True):
        want = {}
        for group in by_key.values():
            if sized and len(group) > C.PAIRED:
                continue
            for n, v, at in group:
                for m, w, to in group:
                    if v != w and (not sized or (min(n, m) * 100 >= 80 * max(n, m) and 1 + min(n - at, m - to) - 1 >= -(-80 * (n + m) // 180))):
                        want[max(find(want, v), find(want, w))] = min(find(want, v), find(want, w))
        frame = spark.createDataFrame(rows, "key long, node long, n long, at long").repartition(4)
        edges = C.bucket_edges(packed(frame if sized else frame.select("key", "node"), sized), *(80, 100) if sized else ()).collect()
        got = {}
        for u, v in edges:
            got[max(find(got, u), find(got, v))] = min(find(got, u), find(got, v))
        for v in range(400):  # what must be together is together
            assert find(got, find(want, v)) == find(got, v)
        if not sized:
            assert len({find(got, v) for v in range(400)}) == len({find(want, v) for v in range(400)})


def test_profiles_bound_the_intersection():
    import numpy as np

    rng = np.random.RandomState(4)
    every = [np.unique(rng.randint(0, 1 << 62, rng.choice([1, 3, 40, 700, 3000, 9000])).astype(np.uint64) * np.uint64(4)) for _ in range(12)]
    for k in range(12):
        s = every[k]
        keep = rng.random(len(s)) < rng.choice([0.85, 0.93, 0.99, 1])
        other = np.union1d(s[keep], rng.randint(0, 1 << 62, int((~keep).sum() * rng.random())).astype(np.uint64) * np.uint64(4))
        every += [other] if len(other) else []
    names = [str(k) for k in range(len(every))]
    linked = {(a, b) for a in range(len(every)) for b in range(len(every)) if a < b and 100 * len(np.intersect1d(every[a], every[b])) >= 90 * len(np.union1d(every[a], every[b]))}
    up = C.Forest()
    edges = list(N.by_profiles(90, 100)(names, [N.profile(s) for s in every]))
    for a, b in edges:
        up.join(a, b)
    assert len(linked) > 5 and all(up.find(a) == up.find(b) for a, b in linked)
    # and it tells most others apart
    together = sum(up.find(a) == up.find(b) for a in range(len(every)) for b in range(a))
    assert together <= len(linked) + 12
    assert list(N.by_profiles(90, 100)(["0", "1"], [N.profile(every[0]), ""])) == []


def test_ids_that_come_twice(spark):
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join([*words[:50], "x", *words[51:]])
    near_a = " ".join([*words[:59], "y"])
    rows = [(9, a), (9, "quite another text of some words"), (5, near_a), (12, "quite another text of some words"), (30, b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in N.near_duplicates(frame).collect()), key=repr) == brute(rows, 3, 90, 100)
    assert {r.component_id for r in N.near_duplicates(frame).collect() if r.doc_id in (5, 9, 12)} == {5}


def test_words_whose_sums_collide_modulo_a_power_of_two(spark):
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, thue), (2, thue.translate(str.maketrans("ab", "ba"))), (3, thue)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in N.near_duplicates(frame).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_candidates_do_not_run_together_by_chance(spark, monkeypatch):
    """Texts that share frequent n-grams and are not alike are candidates neither in pairs nor in one large component."""
    rng = random.Random(12)
    text = lambda words, size: " ".join(f"w{rng.randrange(words)}" for _ in range(size))
    rows = [(k, text(6, rng.randint(30, 50))) for k in range(300)] + [(300 + k, text(12, rng.randint(1300, 1700))) for k in range(100)]
    for k in range(0, 400, 40):  # one near copy of ten of them
        words = rows[k][1].split()
        words[-1] = "changed"
        rows.append((400 + k, " ".join(words)))
    sizes = []
    links = N.links

    def counted(nodes, members, compare):
        sizes.append(nodes.count())
        return links(nodes, members, compare)

    monkeypatch.setattr(N, "links", counted)
    found = sorted((tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert found == brute(rows, 3, 90, 100)
    assert sum(r[0] != r[2] for r in found) == 10 and 20 <= sizes[0] <= 40


def test_similar_sets_have_a_similar_part():
    import numpy as np

    rng = np.random.RandomState(3)
    tried = 0
    for _ in range(400):
        a = np.unique(rng.randint(0, 1 << 62, rng.choice([5, 60, 120, 128, 129, 135, 250, 256, 270, 1000, 3000])).astype(np.uint64) * np.uint64(4))
        keep = np.ones(len(a), bool)
        keep[rng.permutation(len(a))[: rng.randint(0, len(a) // 10 + 1)]] = False
        b = np.union1d(a[keep], rng.randint(0, 1 << 62, rng.randint(0, len(a) // 10 + 1)).astype(np.uint64) * np.uint64(4))
        if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)):
            continue
        tried += 1
        member, part, of, level = N.parts_of([a, b], 90, 100)
        by = {}
        for m, p in zip(member.tolist(), part.tolist()):
            by.setdefault((int(level[p]), m >> 64 - int(level[p])), ({*()}, {*()}))[of[p]].add(m)
        assert any(x | y and 100 * len(x & y) >= 90 * len(x | y) for x, y in by.values())
    assert tried > 100
