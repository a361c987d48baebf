"""Operators on repeated passages, against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from kgloom.llm import op4_suffixes, op9_debruijn, packed

WS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, seed, n=40, words=4, length=60):
    """Texts of few words, with copies, self-repeats, equal ids and null ids."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            old = rng.choice(texts).split(" ")
            i = rng.randrange(len(old))
            text = " ".join(old[:i] + [rng.choice("abé") * rng.randint(1, 2)] * rng.randint(0, 2) + old[i + rng.randint(0, 1):])
        else:
            text = " ".join("".join(rng.choice("abcé\n") for _ in range(rng.randint(1, words))) for _ in range(rng.randint(0, length)))
        texts.append(text)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[5]), (n + 1, None), (n + 2, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def brute9(rows, k):
    docs = [(r["doc_id"], WS.findall(r["text"] or "")) for r in rows]
    coordinate = lambda d, i: (d is None, d or 0, i)
    first = {}
    for d, w in docs:
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, (2,)), coordinate(d, i))
    out = Counter()
    for d, w in docs:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < coordinate(d, i):
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("seed,k,chunk,bucket", [(1, 3, 200, 50), (2, 5, 10_000, 1 << 20), (3, 2, 500, 10), (4, 20, 300, 100)])
def test_debruijn(spark, seed, k, chunk, bucket, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(packed, "BUCKET_KEYS", bucket)
    docs = corpus(spark, seed, words=2 if k < 20 else 1, length=90)
    want = brute9(docs.collect(), k)
    got = op9_debruijn.dedup(docs, window=k).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert sum(r["n_removed"] for r in got) > 0


def test_debruijn_odd(spark, odd, empty, some):
    for docs in (odd, some):
        got = op9_debruijn.dedup(docs).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute9(docs.collect(), 20)
    assert op9_debruijn.dedup(empty).count() == 0


def brute4(rows, k):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
    n = Counter(b[i:i + k] for _, b in docs for i in range(len(b) - k + 1))
    out = Counter()
    for d, b in docs:
        gone = {j for i in range(len(b) - k + 1) if n[b[i:i + k]] > 1 for j in range(i, i + k)}
        spans = sum(i not in gone and i + 1 in gone for i in range(-1, len(b)))
        out[d, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()] += 1
    return out


def result4(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("seed,k,chunk,bucket,segment", [(1, 12, 200, 50, 64), (2, 20, 10_000, 1 << 20, 1 << 20), (3, 2, 500, 10, 100), (4, 47, 300, 100, 50)])
def test_suffixes(spark, seed, k, chunk, bucket, segment, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(packed, "BUCKET_KEYS", bucket)
    monkeypatch.setattr(op4_suffixes, "SEGMENT", segment)
    docs = corpus(spark, seed)
    got = result4(op4_suffixes.dedup(docs, window=k))
    assert got == brute4(docs.collect(), k)
    assert sum(x[2] for x in got) > 0


def test_suffixes_odd(spark, odd, empty, some):
    for docs in (odd, some):
        assert result4(op4_suffixes.dedup(docs)) == brute4(docs.collect(), 200)
    assert op4_suffixes.dedup(empty).count() == 0


def test_covers():
    for v, cover in op4_suffixes.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
