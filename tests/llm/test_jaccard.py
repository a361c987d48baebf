import random
import re
from collections import Counter

import pytest

from kgloom.llm import graph, op5_jaccard, packed


def brute(rows):
    sets, ids = [], []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        ids.append(r["doc_id"])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((ids[i], len(sets[i]), least[find(i)]) for i in range(len(sets)))


def result(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("seed,chunk,bucket,tile", [(1, 2000, 500, 2), (2, 1 << 20, 1 << 20, 2048)])
def test_jaccard(spark, seed, chunk, bucket, tile, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(packed, "BUCKET_KEYS", bucket)
    monkeypatch.setattr(op5_jaccard, "TILE", tile)
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzé")
    texts = [[word() for _ in range(rng.randint(1, 80))] for _ in range(12)]
    for _ in range(70):  # chains of edits
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = word()
        texts.append(t + [word() for _ in range(rng.randint(0, 4))])
    common = [word() for _ in range(25)]
    texts += [common + [word() for _ in range(rng.randint(0, 12))] for _ in range(20)]
    rows = [(i, " ".join(t) if i % 3 else "\n".join(t).upper().replace("É", "é")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (3, rows[4][1]), (500, None), (501, " ")], "doc_id bigint, text string").repartition(3)
    want = brute(docs.collect())
    assert result(op5_jaccard.join(docs)) == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_jaccard_odd(odd, some, empty):
    for docs in (odd, some):
        assert result(op5_jaccard.join(docs)) == brute(docs.collect())
    assert op5_jaccard.join(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (50, 40), (50, 41), (50, 42)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, **{i: 40 for i in (50, 40, 41, 42)}}
