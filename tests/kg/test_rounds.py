"""Loops take few rounds, and rounds send no table through the driver."""

import random
import time

import pytest
from pyspark.sql import functions as F

from kgloom.operators import analytics
from test_whole import brute_components


def test_ring_with_tail_by_doubling(spark, monkeypatch):
    tables, cut = [], analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df: tables.append(1) or cut(df))
    monkeypatch.setattr(analytics.Rounds, "add", lambda self, df, add=analytics.Rounds.add: tables.append(1) or add(self, df))
    ring, tail = 50, 40
    edges = [(f"r{i:02}", f"r{(i + 1) % ring:02}") for i in range(ring)] + [(f"t{i:02}", f"t{i + 1:02}" if i < tail - 1 else "r07") for i in range(tail)]
    e = spark.createDataFrame(edges, "src string, dst string")
    assert {r["node"]: r["height"] for r in analytics.heights(e).collect()} == {**{f"r{i:02}": 1 for i in range(ring)}, **{f"t{i:02}": tail - i + 1 for i in range(tail)}}
    assert len(tables) < ring


@pytest.mark.parametrize("n,m", [(20, 30), (30, 36)])
def test_chains_within_cycles(spark, n, m):
    rng = random.Random(n)
    edges = sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)} | {("n00", "c1"), ("c1", "c2"), ("c2", "n00"), ("n00", "n01"), ("c1", "c1")})
    _, comp, height = brute_components(edges)
    e = spark.createDataFrame(edges, "src string, dst string")
    assert {r["node"]: r["component"] for r in analytics.components(e).collect()} == comp
    assert {r["node"]: r["height"] for r in analytics.heights(e).collect()} == height


def test_rounds_of_layers_broadcast_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(analytics.Rounds, "add", lambda self, df, add=analytics.Rounds.add: plans.append(df._jdf.queryExecution().executedPlan().toString()) or add(self, df))
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")], "src string, dst string")
    assert {r["node"]: r["depth"] for r in analytics.layer_depth(analytics.backbone(e), e).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert len(plans) == 4 and not any("BroadcastHashJoin" in p for p in plans[1:])


def test_fused_names_resolve_once(spark, monkeypatch):
    from kgloom.operators import fuse

    calls, resolve = [], fuse.resolve
    monkeypatch.setattr(fuse, "resolve", lambda *a: calls.append(1) or resolve(*a))
    text = spark.createDataFrame([(None, "loop", "MENTIONS_KP", None, "Array", "", "t", "S1", 1)], "subject_id string, subject_name string, predicate string, object_id string, object_name string, evidence string, source string, section_key string, ord bigint")
    code = spark.createDataFrame([("c", "f", "array", "x", "", "s", "a.c", 1)], "subject_id string, subject_name string, mapped_kp string, object_name string, evidence string, source string, file_path string, ord bigint")
    gold = spark.createDataFrame([("G1", "CH1", "1", "t", "q", ["loop"], [("related", " array ")], 1)], "sample_id string, chapter_id string, section string, text_fragment string, question string, knowledge_points array<string>, relation_hints array<struct<type: string, target: string>>, ord bigint")
    words = spark.createDataFrame([("loops", "K1", 1), ("array", "K2", 2)], "key string, value string, ordinal int")
    triples, _ = fuse.fuse(text, code, gold, words)
    assert {(r["predicate"], r["object_id"]) for r in triples.collect()} == {("MENTIONS_KP", "K2"), ("IMPLEMENTS_KP", "K2"), ("GOLD_LABEL", "K1"), ("RELATED", "K2")}
    assert len(calls) == 1


def test_term_index_is_read_not_made_again(spark):
    from kgloom.operators import resolve

    texts = spark.createDataFrame([(1, "an array of loops"), (2, "none")], "doc_id int, text string")
    hits = resolve.term_hits(texts, spark.createDataFrame([("array",), ("loop",), ("tree",)], "term string"))
    assert "MapInArrow" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in hits.collect()} == {(1, "array"), (1, "loop")}


def test_more_starts_than_a_row_has(spark):
    n = analytics.WORD * analytics.WORDS + 90
    e = spark.createDataFrame([(f"s{i:04}", "x") for i in range(n)] + [("x", "y")], "src string, dst string")
    got = analytics.reachable(e, spark.createDataFrame([(f"s{i:04}",) for i in range(n)], "node string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"s{i:04}", x, d) for i in range(n) for x, d in (("x", 1), ("y", 2)))


def test_tables_of_rounds_leave_no_shuffle_files(spark):
    from kgloom.plans.staging import Rounds, cut

    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    Rounds(spark, "round").add(cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).repartition(3, "k"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_texts_of_a_few_bytes_are_cleaned_by_many_tasks(spark):
    from kgloom.operators import text

    docs = spark.createDataFrame([(i, f"line {i} a\nint main() {{\n  return {i};\n}}\nthe end of it\n") for i in range(40)], "doc_id bigint, text string")
    cleaned = text.clean_document(docs)
    assert cleaned.select("doc_id", F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0] == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tables_of_names_are_not_broadcast(spark, monkeypatch):
    plans, cut = [], analytics.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(analytics, "cut", lambda df: cut(plan(df)))
    monkeypatch.setattr(analytics.Rounds, "add", lambda self, df, add=analytics.Rounds.add: add(self, plan(df)))
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e")], "src string, dst string")
    nodes = analytics.backbone(e)
    assert {r["node"]: r["depth"] for r in plan(analytics.layer_depth(nodes, e)).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r["node"]: r["height"] for r in plan(analytics.heights(e)).collect()} == {"a": 4, "b": 3, "c": 3, "d": 2, "e": 1}
    assert len(plans) > 8 and [p for p in plans if "BroadcastHashJoin" in p] == []


def test_rounds_of_few_edges_take_few_tasks(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e")], "src string, dst string").withColumn("ord", F.concat_ws("|", "src", "dst"))
    sc, parts = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    sc.setJobGroup("rounds", "")
    try:
        assert sorted(tuple(r) for r in analytics.main_chain(e).collect()) == [(0, "a"), (1, "b"), (2, "d"), (3, "e")]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("rounds") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert len(stages) > 20 and max(s.numTasks for s in stages if s) < 40


def test_edges_are_dealt_to_more_tasks_where_there_are_more(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(analytics, "EDGES", 2)
    monkeypatch.setattr(analytics, "_dealt", lambda df, key, n, f=analytics._dealt: dealt.append(n) or f(df, key, n))
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e")], "src string, dst string")
    assert {r["node"]: r["depth"] for r in analytics.layer_depth(analytics.backbone(e), e).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert dealt == [4, 4]


def test_chains_are_not_broadcast(spark, monkeypatch):
    plans, cut = [], analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string").withColumn("ord", F.concat_ws("|", "src", "dst"))
    assert [r["node"] for r in analytics.main_chain(e).orderBy("position").collect()] == [f"n{i}" for i in range(10)]
    assert [p for p in plans if "BroadcastHashJoin" in p] == []


def test_parts_of_answers_in_one_pass(spark):
    from kgloom.operators import imports
    from kgloom.plans import change_queries

    docs = spark.createDataFrame([(1, "第 1 章 变量\n数组\n指针"), (2, None)], "doc_id bigint, text string").repartition(2, "doc_id")
    parts = change_queries._parts(imports.fallback(docs))
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    want = {(1, "chapter", "CH01", "第 1 章 变量", "1"), (1, "kp", "KP0002", "数组", "CH01"), (1, "relation", "KP0001", "KP0002", "基于文本规则抽取的相邻知识点关系"), (2, "chapter", "CH01", imports.DEFAULT_CHAPTERS[0], "1")}
    assert want <= {tuple(r) for r in parts.collect()}
    nothing = spark.createDataFrame([(3, None, None, None)], "doc_id bigint, chapters array<struct<chapter_id: string, title: string, order: bigint>>, kps array<struct<kp_id: string, name: string, chapter_id: string>>, relations array<struct<source: string, target: string, description: string>>")
    assert change_queries._parts(nothing).collect() == []


def test_rounds_of_reachable_move_what_they_find_and_not_the_edges(spark, monkeypatch):
    """Edges stay where they are dealt: a round deals the nodes found last and what they hit, and nothing else."""
    from kgloom.plans import staging

    plans, add = [], staging.Rounds.add

    def spy(self, df):
        with staging._freed(spark, self.parts):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return add(self, df)

    monkeypatch.setattr(staging.Rounds, "add", spy)
    e = spark.createDataFrame([(f"n{i:03}", f"n{j:03}") for i in range(60) for j in (i + 1, i * 2 % 60)], "src string, dst string")
    analytics.reachable(e, spark.createDataFrame([("n000",), ("n001",)], "node string")).count()
    assert len(plans) > 3
    for plan in plans[1:]:
        moves = [line for line in plan.splitlines() if "Exchange" in line]
        assert any("REPARTITION_BY_NUM" in line for line in moves) and sum("REPARTITION_BY_NUM" not in line for line in moves) == 2, moves


def test_folded_rounds(spark):
    """A path of more rounds than are read one by one, with a way back, so that what was found long ago is met again."""
    n = 3 * analytics.FOLD + 2
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(n)] + [(f"n{n:02}", "n00"), (f"n{n:02}", "n05")]
    got = analytics.reachable(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("n00",), ("n03",), ("absent",)], "node string")).collect()
    want = {("n00", f"n{i:02}", i) for i in range(1, n + 1)} | {("n00", "n00", n + 1)} | {("n03", f"n{i:02}", i - 3) for i in range(4, n + 1)} | {("n03", f"n{i:02}", n - 2 + i) for i in range(4)}
    assert sorted(tuple(r) for r in got) == sorted(want)
