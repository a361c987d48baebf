import zlib
from collections import Counter

import pytest

from kgloom.llm import op6_sharding as op


@pytest.mark.parametrize("which", ["odd", "some", "empty"])
@pytest.mark.parametrize("cell_rows", [100_000, 1])
def test_shards(which, cell_rows, request, monkeypatch):
    monkeypatch.setattr(op, "SLOTS", 8)
    docs = request.getfixturevalue(which)
    rows = op.shard(docs, nodes=2, shards=3, cell_rows=cell_rows).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs.collect())
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    n = Counter(r["shard"] for r in rows)
    assert not rows or max(n.values()) - min(n.get(s, 0) for s in range(3)) <= 1


def test_place():
    owner = op.ring(16, 64)
    assert set(owner) == set(range(16))
    counts = [(7 * i) % 13 for i in range(op.SLOTS)]
    counts[5] = 9000  # a hot slot overflows clockwise
    plan = op.place(counts, owner, 16)
    for slot, n in enumerate(counts):
        ranks = sorted((lo, hi) for s, lo, hi, _, _ in plan if s == slot)
        assert (sum(hi - lo for lo, hi in ranks) == n) and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:], strict=False))
    load = Counter()
    for _, lo, hi, s, _ in plan:
        load[s] += hi - lo
    assert max(load.values()) - min(load.values()) <= 1
    even = [10] * op.SLOTS
    moved = sum(hi - lo for s, lo, hi, shard, _ in op.place(even, owner, 16) if shard != owner[s])
    home = Counter()
    for s in range(op.SLOTS):
        home[owner[s]] += 10
    assert moved == sum(max(0, h - sum(even) // 16) for h in home.values())
