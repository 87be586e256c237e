"""Search over a stored index against plain Python; a document's words stay in a row."""

import math
import random

from tessera.operators import search

WORDS = [f"w{k}" for k in range(12)]


def corpus(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS[: rng.randint(2, 12)]) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    docs = [*enumerate(texts), (3, "w1 w2 w3"), (500, None), (501, "...")]
    asked = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))) for k in range(30)] + [(40, "w1 w2 absent"), (41, ""), (42, "w1 w1")]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    return docs, asked, frame(docs, "doc_id long, text string"), frame(asked, "query_id long, query string")


def test_phrases_are_looked_up_where_their_rarest_place_is(spark):
    docs, asked, d, q = corpus(spark)
    index = search.stored_index(d, "doc_id", ["text"], [])
    assert index.count() == len({k for k, t in docs if t and t != "..."} - {k for k, t in docs if t == ""} | {3})
    places = {}
    for k, t in docs:
        for p, w in enumerate((t or "").replace(".", "").split()):
            places.setdefault((k, w), set()).add(p)
    for slop in (0, 2):
        want = set()
        for n, text in asked:
            words = text.split()
            for k in {k for k, _ in docs}:
                bases = set(range(-slop, 30)) if words else set()
                for at, w in enumerate(words):
                    bases &= {p - at - x for p in places.get((k, w), ()) for x in range(slop + 1)}
                if bases:
                    want.add((n, k))
        each = [search.phrase_hits(q, i, "doc_id", ["text"], slop, []) for i in (index, search.postings(d, "doc_id", ["text"], []))]
        assert want and all({(r.query_id, r.doc_id) for r in e.collect()} == want for e in each)


def test_scores_of_a_stored_index_and_of_some_documents(spark):
    docs, asked, d, q = corpus(spark)
    bags = {}
    for k, t in docs:
        if words := (t or "").replace(".", "").split():
            bags.setdefault(k, []).extend(words)
    mean = sum(map(len, bags.values())) / len(bags)
    want = {}
    for n, text in asked:
        for w in set(text.split()):
            df = sum(w in b for b in bags.values())
            for k, b in bags.items():
                if w in b:
                    tf = b.count(w)
                    want[n, k] = want.get((n, k), 0) + math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))
    index = search.stored_index(d, "doc_id", ["text"], [])
    found = {(r.query_id, r.doc_id): r.score for r in search.bm25(q, index, "doc_id", {"text": 1.0}, []).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)
    hits = search.phrase_hits(q, index, "doc_id", ["text"], 0, [])
    pairs = {(r.query_id, r.doc_id) for r in hits.collect()}
    some = {(r.query_id, r.doc_id): r.score for r in search.bm25(q, index, "doc_id", {"text": 1.0}, [], only=hits).collect()}
    assert pairs and some.keys() == pairs and all(math.isclose(some[k], want[k], rel_tol=1e-9) for k in pairs)
