import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing as P
from tessera.llm.queries import tokenizer_path


def plain(counts, capacity):
    """Best-fit-decreasing, one by one."""
    gaps = []
    for n in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps[gaps.index(min(fit))] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_best_fit_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 50, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 20) for _ in range(rng.randint(0, 15))}
        steps, n = P.best_fit(counts, capacity)
        used = {}
        for length, first, end, k, sequence, offset in steps:
            for r in range(first, end):
                used.setdefault(sequence + (r - first) // k, []).append((offset + (r - first) % k * length, length))
        assert n == len(used) == plain(counts, capacity)
        assert sum(map(len, used.values())) == sum(counts.values())
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity


def test_words_are_the_tokenizer(data):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()
    texts += ["don't stop!'s it's.'s x", "a...b .. c!'", "ΑΣ. Σ", "İstanbul ıI", "é x́y", "a b\tc\r\nd", "", " ", "12.5% ½ ①② x²", "日本語。テスト", "ﬁne ß ẞ", "x" * 50_000, "\x00 \x1c."]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    words = P.Words(tokenizer_path())
    assert words.ids(texts) == want and words.ids(texts) == want


def test_random_unicode():
    rng = random.Random(7)
    letters = ["a", "Z", "İ", "ı", "Σ", "ς", "ß", "ẞ", "é", "É", "e\u0301", "\u0301", "\u0958", "ﬁ", "日", "ж", "٣", "5", "½", "\u200d", "'s", "'T", "<|endoftext|>", "<|ENDOFTEXT|>", "\u00a0", "\t", "\u0338", "=", "\ufb1d", "Ω", "K"]
    texts = ["".join(rng.choice(letters if rng.random() < 0.7 else [*P.SIGNS, " ", "\n", "-", "("]) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += [w + t for w in ("DENİZLİ", "MERSİ", "İ", "क\u0958", "<|ENDOFTEXT|>", "ABC <|EndOfText|>") for t in ("", ", x", "! ok", *P.SIGNS)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    words = P.Words(tokenizer_path())
    assert [t for t, a, b in zip(texts, words.ids(texts), want, strict=True) if a != b] == []


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "of", "Zebra", "12"]) for _ in range(rng.choice([0, 1, 5, 300, 4095, 4096, 9000])))) for k in range(60)]
    rows += [(100, None), (None, "a b"), (3, rows[3][1])]
    parts = P.pieces(spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).repartition(4), tokenizer_path())
    found = P.pack(parts).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(k, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for a in range(0, len(ids), 4096)]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == list(np.cumsum([0, *(n for _, n in sorted(p))])[:-1])
        assert sum(n for _, n in p) <= 4096


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    rows = spark.createDataFrame([(1, "x")][:n], "doc_id long, text string")
    assert P.pack(P.pieces(rows, tokenizer_path())).count() == n
