"""Queries over whole tables on inputs that bounds, cuts and filters would show up on."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import analytics
from kgloom.plans import catalog, graphview
from test_queries import D, TABLES, rows


def views(d, tables=TABLES):
    import duckdb

    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A small graph whose parts go from 3 to 600."""
    d, c = tmp_path_factory.mktemp("far"), views(D)
    for t, query in {"nation": "SELECT * FROM nation", "supplier": "SELECT * FROM supplier", "part": "SELECT * REPLACE (p_partkey * 3 AS p_partkey) FROM part",
                     "lineitem": "SELECT * REPLACE (l_partkey * 3 AS l_partkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40)"}.items():
        c.sql(f"COPY ({query}) TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d)


DAG = ["out_neighbors", "in_neighbors", "backbone", "layer_depth", "main_chain_height", "main_chain", "reachability", "focus_subgraph", "roles", "style_roles", "nearest_main",
       "chain_edges", "graph_stats", "in_degree", "detach_delete", "layered_positions"]


@pytest.mark.parametrize("name", DAG)
def test_graph(spark, far, name):
    want = rows(views(far, ["nation", "supplier", "part", "lineitem"]).sql(catalog.oracle_sql()[name]).df())
    assert rows(catalog.queries()[name](spark, far).toPandas()) == want


def test_cycles(spark):
    """A cycle holds its nodes back from layering, and is one step of the longest path."""
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "b", 3), ("c", "d", 4), ("a", "e", 5)], "src string, dst string, ord int")
    depth = {r["node"]: r["depth"] for r in analytics.layer_depth(analytics.backbone(edges), edges).collect()}
    assert depth == {"a": 0, "e": 1, "b": 1, "c": 1, "d": 1}
    assert {r["node"]: r["height"] for r in analytics.heights(edges).collect()} == {"a": 3, "b": 2, "c": 2, "d": 1, "e": 1}
    assert {r["position"]: r["node"] for r in analytics.main_chain(edges).collect()} == {0: "a", 1: "b", 2: "d"}
    ring = spark.createDataFrame([("x", "y", 1), ("y", "x", 2), ("z", "z", 0)], "src string, dst string, ord int")
    assert {r["node"]: r["component"] for r in analytics.components(ring).collect()} == {"x": "x", "y": "x", "z": "z"}
    assert [tuple(r) for r in analytics.main_chain(ring).collect()] == [(0, "z")]


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    to = {n: {b for a, b in edges if a == n} for n in nodes}
    lead = {}
    for n in nodes:
        seen, left = set(), list(to[n])
        while left:
            x = left.pop()
            if x not in seen:
                seen.add(x)
                left += to[x]
        lead[n] = seen
    comp = {n: min([n, *(m for m in lead[n] if n in lead[m])]) for n in nodes}

    @functools.cache
    def height(c):
        return 1 + max([height(comp[b]) for a, b in edges if comp[a] == c and comp[b] != c], default=0)

    return lead, comp, {n: height(comp[n]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 3])
def test_random_cycles(spark, seed):
    rng = random.Random(seed)
    n = 24
    edges = sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range([14, 24, 30, 45][seed])})
    lead, comp, height = brute_components(edges)
    e = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src string, dst string, ord int")
    assert {r["node"]: r["component"] for r in analytics.components(e).collect()} == comp
    assert {r["node"]: r["height"] for r in analytics.heights(e).collect()} == height
    chain = [r["node"] for r in analytics.main_chain(e).orderBy("position").collect()]
    assert len(chain) == max(height.values()) and [height[c] for c in chain] == list(range(len(chain), 0, -1))
    assert all(comp[c] == c for c in chain) and all(any(comp[x] == a and comp[y] == b for x, y in edges) for a, b in zip(chain, chain[1:], strict=False))
    starts = spark.createDataFrame([(x,) for x in comp], "node string")
    assert {(r["start"], r["node"]) for r in analytics.reachable(e, starts).collect()} == {(a, b) for a in lead for b in lead[a]}


def test_many_starts(spark):
    """More starts than a word has bits, the last bit included; distances both ways."""
    k = 130
    edges = [(i, (2 * i + j) % k) for i in range(k) for j in (0, 1)]
    want = {}
    for way, pairs in (("forward", edges), ("backward", [(b, a) for a, b in edges])):
        for start in range(k):
            level, seen, d = {start}, set(), 0
            while level := {b for a, b in pairs if a in level} - seen:
                d, seen = d + 1, seen | level
                want |= {(way, f"{start:03}", f"{n:03}"): d for n in level}
    e = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in edges], "src string, dst string")
    assert {(r["direction"], r["start"], r["node"]): r["distance"] for r in analytics.reachable_both(e, analytics.backbone(e)).collect()} == want


def test_reachability_follows_every_type(spark, far):
    """Starts reach over all edges of the graph, from chapters and examples too, and pairs in descending order count."""
    edges = {(r["src"], r["dst"]) for r in graphview.graph(spark, far).edges.collect()}
    nodes, want = {x for e in edges for x in e}, set()
    for way, pairs in (("forward", edges), ("backward", {(b, a) for a, b in edges})):
        to = {}
        for a, b in pairs:
            to.setdefault(a, set()).add(b)
        for start in (x for x in nodes if int(x[2:]) % 50 == 0):
            level, seen, d = {start}, set(), 0
            while level := {b for a in level for b in to.get(a, ())} - seen:
                d, seen = d + 1, seen | level
                want |= {(way, start, n, d) for n in level}
    got = [tuple(r) for r in catalog.queries()["reachability"](spark, far).collect()]
    assert sorted(got) == sorted(want)
    assert {s[:2] for _, s, _, _ in got} == {n[:2] for _, _, n, _ in got} == {"CH", "EX", "KP"}


def test_wide_keys(spark):
    """Numbers of more digits than a key's width stay apart."""
    got = [r[0] for r in spark.createDataFrame([(1234567,), (1234560,), (42,)], "n bigint").select(graphview._key("KP", F.col("n"), 6)).collect()]
    assert got == ["KP1234567", "KP1234560", "KP000042"]


def test_long_chain(spark):
    """The chain doubles: 40 nodes, side branches, ties by edge order."""
    rows_ = [(f"n{i:02}", f"n{i + 1:02}", i) for i in range(39)] + [("n05", "x", 100), ("y", "n01", 101), ("n00", "n02", 102)]
    edges = spark.createDataFrame(rows_, "src string, dst string, ord int")
    assert {r["position"]: r["node"] for r in analytics.main_chain(edges).collect()} == {i: f"n{i:02}" for i in range(40)}


def test_long_texts(spark, tmp_path):
    """An anchor word and twelve characters that only stand behind the cuts."""
    c = views(D, ["nation"])
    c.sql(f"COPY (SELECT * FROM nation) TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    text = "some words " + " " * 40 + "and then the anchor 指针"
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    q = catalog.queries()
    score = {k: q[k](spark, str(tmp_path)).first()[1] for k in ("quality_score", "quality_reasons", "hard_reject")}
    assert score["hard_reject"] is None and score["quality_reasons"] == "category=other" or score["quality_reasons"].startswith("缺少") and score["quality_score"] == 80


def test_all_rows(spark):
    duck, q = views(D), catalog.queries()
    assert q["chapter_rollup"](spark, D).selectExpr("sum(sections)").first()[0] == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_priority(spark):
    parts = views(D).sql("SELECT p_name, p_partkey FROM part").fetchall()
    key = lambda n: "".join(n.lower().split())
    new, old = {}, {}
    for n, k in parts:
        for index, by, x in ((new, 5, "N"), (old, 2, "O")):
            at = key(n) + ("" if k % by == 0 else "!")
            index[at] = max(index.get(at, ""), f"{x}{k}")
    link = lambda n, k: {0: n.upper(), 3: n + "?", 1: n + "!"}.get(k % 6, n)
    want = {(link(n, k), k): new.get(key(link(n, k)), old.get(key(link(n, k)))) for n, k in parts}
    got = {(r["name"], r["k"]): r["kp_id"] for r in catalog.queries()["priority_lookup"](spark, D).collect()}
    assert got == want and len({(v or "-")[0] for v in want.values()}) == 3


def test_replay(spark):
    """Every event is played, over a base of every event."""
    events = views(D).sql("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id").fetchall()
    text = spark.read.parquet(f"{D}/events.parquet").selectExpr("event_id", "cast(value as string) AS value")  # numbers as Spark writes them
    values, state = {r["event_id"]: r["value"] for r in text.collect()}, {}
    for i, u, t, _ in events:
        label, value = state.get(str(u % 500), ("", ""))
        state[str(u % 500)] = (max(label, t), max(value, values[i] or ""))
    for i, u, t, _ in events:
        n, row = str(u % 600), (None if t == "click" else t, values[i])
        if i % 11 == 0:
            state.pop(n, None)
        elif i % 3 == 0:
            state[n] = row
        elif n in state:
            state[n] = tuple(b if a is None else a for a, b in zip(row, state[n], strict=True))
    want = {n: (a, None if b is None else float(b)) for n, (a, b) in state.items()}
    got = {r["node"]: (r["label"], r["value"]) for r in catalog.queries()["apply_replay"](spark, D).collect()}
    assert got == want
