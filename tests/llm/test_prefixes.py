"""The conversation tree against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from kgloom.llm import op13_prefixes as op

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(first, [])[:h] + ts[h:])
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(built[c][:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = leaves.get(k, 0) or 1
        saved[k] = saved.get(k, 0) + (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
            leaves[k[:-1]] = leaves.get(k[:-1], 0) + leaves[k]
            saved[k[:-1]] = saved.get(k[:-1], 0) + saved[k]
    return sorted((m[0], len(k), nodes[k[:-1]][0] if k else -1, len(m), kids.get(k, 0), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in m if built[c] == k).encode()).hexdigest()) for k, m in nodes.items())


def result(spark, rows, monkeypatch, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = op.op13_prefixes(spark, str(tmp_path))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in out.collect())


@pytest.mark.parametrize("block", [256, 3])
def test_random(spark, monkeypatch, tmp_path, block):
    """Deep trees over few turns, copies, ids below zero, nulls and ties; blocks of three depths cut most chains."""
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "END_BITS", 2)
    rng = random.Random(block)
    rows = []
    for c in [*range(-7, 60), 1000, 1003]:
        path = [rng.choice("aab") * rng.randrange(3) for _ in range(rng.randrange(1, 30))] if rng.random() < 0.7 else ["a"] * rng.randrange(1, 30)
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["u", "u", None]), x or None) for t, x in enumerate(path)]
    rows += [(5, 2, "u", "é"), (5, 2, "u", "é"), (None, 1, "u", "lost")]
    rng.shuffle(rows)
    assert result(spark, rows, monkeypatch, tmp_path) == brute(rows)


def test_staircase(spark, monkeypatch, tmp_path):
    """Each conversation leaves the one before a turn later: as many chains on a path as conversations."""
    monkeypatch.setattr(op, "HEADS", 1)
    monkeypatch.setattr("zlib.crc32", lambda b: 0)
    rows = [(c, t, "u", "x" if t < c else f"own {c}") for c in range(40) for t in range(c + 2)] + [(100 + i, t, "u", "x") for i in range(30) for t in range(4)]
    assert result(spark, rows, monkeypatch, tmp_path) == brute(rows)


def test_edges(spark, monkeypatch, tmp_path):
    assert result(spark, [], monkeypatch, tmp_path / "none") == []
    one = [(7, None, None, None)]  # h of 7 is more than one turn, 5 isn't there: no turns are left
    assert result(spark, one, monkeypatch, tmp_path / "one") == brute(one) and len(brute(one)) == 1
    clash = spark.createDataFrame([(1, 0, "u", "x", 3, "y"), (2, 0, "u", "x", 4, "z")], SCHEMA + ", depth int, Owner string")
    nodes, ends = op.tree(clash)
    assert {r["n_convs"] for r in nodes.collect()} <= {1, 2} and {r["end_id"] for r in ends.collect()} == {1, 2}
