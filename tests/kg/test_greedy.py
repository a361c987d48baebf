"""Greedy dedup against the fold over rows in order, and plans without nested loops."""

import random

import pytest

from kgloom.operators import dedup


def fold(rows, threshold=0.75):
    names, kept, out = set(), {}, []
    for ord_, section, name in sorted(rows):
        n = " ".join(name.split())
        chars = set(n.lower()) - {""}
        near = any(chars and c and len(chars & c) / len(chars | c) > threshold for c in kept.get(section, []))
        if n not in names and not near:
            out.append(ord_)
            names.add(n)
            kept.setdefault(section, []).append(chars)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_fold(spark, seed):
    """Families of near names, names of several sections, repeated rows, an empty name, a null section."""
    rng = random.Random(seed)
    base = ["abcdefgh", "abcdefg", "abcdefghi", "bcdefghi", "xyz", "xyzw", "xyzwv", "循环语句", "循环语句的", "指针", "", "abcdefgz"]
    orders = rng.sample(range(1000), 60)
    rows = [(o, rng.choice(["s1", "s2", None]), rng.choice(base) + rng.choice(["", "", "q"])) for o in orders]
    got = dedup.greedy(spark.createDataFrame(rows, "ord bigint, section_key string, name string"))
    assert got.columns == ["ord", "section_key", "name"] and sorted(r["ord"] for r in got.collect()) == fold([(o, s, n) for o, s, n in rows])


def test_chain(spark):
    """Each name is near the next only: every other one stays, decided one after the other."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, "s", alphabet[i:i + 9]) for i in range(8)]
    got = dedup.greedy(spark.createDataFrame(rows, "ord bigint, section_key string, name string"))
    assert sorted(r["ord"] for r in got.collect()) == fold(rows) == [0, 2, 4, 6]


def test_nothing(spark):
    assert dedup.greedy(spark.createDataFrame([], "ord bigint, section_key string, name string")).collect() == []


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.75, 0.9])
def test_near_sets(spark, threshold):
    """Against all pairs, in both directions and within sections only."""
    rng = random.Random(7)
    sets = [(rng.choice("st"), i, "".join(sorted(rng.sample("abcdefghijkl", rng.randrange(1, 12))))) for i in range(90)] + [("s", 90, "")]
    want = {(a, b) for s, a, x in sets for t, b, y in sets if a != b and s == t and x and y and len({*x} & {*y}) / len({*x} | {*y}) > threshold}
    got = dedup.near_sets(spark.createDataFrame(sets, "section_key string, id bigint, x string").selectExpr("section_key", "id", "filter(split(x, ''), c -> c <> '') cs"), threshold)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_names_of_the_same_characters_are_not_paired(spark, monkeypatch):
    seen, near_sets = [], dedup.near_sets
    monkeypatch.setattr(dedup, "near_sets", lambda sets, t: seen.append(sets.count()) or near_sets(sets, t))
    rows = [(i, "s", "ab" * (i + 1)) for i in range(300)] + [(300, "t", "abab"), (301, "t", "ab")]
    got = dedup.greedy(spark.createDataFrame(rows, "ord bigint, section_key string, name string"))
    assert sorted(r["ord"] for r in got.collect()) == fold(rows) and seen == [2]
