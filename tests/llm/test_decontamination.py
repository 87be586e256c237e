import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {65 + k: 97 + k for k in range(26)}


def brute(docs, items, size=13):
    wins = {}
    for i, x in items:
        w = WORD.findall((x or "").translate(LOW))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, x in docs:
        w, hit, ids = WORD.findall((x or "").translate(LOW)), set(), set()
        for n in {len(q) for q in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    ids |= found
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "été", "x1", "42", "straße", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 12, 13, 14, 30]))) for k in range(12)] + [(3, "alpha"), (90, ""), (91, "..."), (92, None)]
    docs = []
    for k in range(120):
        parts = [text(rng.randint(0, 40))]
        if rng.random() < 0.5:
            parts.append(rng.choice(items)[1] or "")
        docs.append((k, ", ".join(parts)))
    return docs + [(500, None), (501, ""), (None, items[0][1]), (7, docs[7][1]), (502, "alpha-" * 5000)], items


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in D.digest(D.decontaminate(d, i, **options)).collect()), key=repr)


def test_brute_force(spark):
    for seed in range(3):
        docs, items = case(seed)
        assert run(spark, docs, items) == brute(docs, items)


def test_several_scans(spark):
    docs, items = case(5)
    assert run(spark, docs, items, max_windows=20) == brute(docs, items)


def test_spans(spark):
    d = spark.createDataFrame([(1, "Für ÉTÉ, ﬁn: alpha  BETA gamma!")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    r = D.decontaminate(d, i).first()
    assert [d.first().text[s.start : s.end] for s in r.spans] == ["alpha  BETA"] and r["items"] == ["1"]


def test_empty(spark):
    docs, items = case(1)
    assert run(spark, [], items) == []
    assert all(r[2] == 0 for r in run(spark, docs, []))
