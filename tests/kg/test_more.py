"""Operators that no query reaches: readers, gates, candidates, fusion of code and gold labels, orders."""

import pytest
from pyspark.sql import functions as F

from kgloom import model
from kgloom.operators import dedup, extract, fuse, graph, quality, review, store, text
from kgloom.sources import files

LONG = "这个知识点的描述足够长，一共超过三十个字符，所以不会因为太短而被去掉。"


def test_order(spark):
    """Labels by sound, not by code point; histograms by count."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["重复", "数组", "指针", "b", "阿", "A", "数组"])], "id int, label string")
    assert [r["label"] for r in graph.by_label(rows).collect()] == ["阿", "数组", "数组", "指针", "重复", "A", "b"]
    assert [r["label"] for r in rows.orderBy("label").collect()] != [r["label"] for r in graph.by_label(rows).collect()]
    t = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b"), (None, "b")], "predicate string, source string")
    assert [tuple(r) for r in dedup.counts_by(t, "predicate", "source").collect()] == [("predicate", "p", 2), ("predicate", None, 1), ("predicate", "q", 1), ("source", "b", 3), ("source", "a", 1)]


def test_readers(spark, tmp_path):
    sec = [("CH1", "1.1", "t", "x", ["c"], 1, 1), ("CH2", "2.1", "t", "y", None, 1, 0)]
    files.write_jsonl(spark.createDataFrame(sec, model.SECTION), f"{tmp_path}/s.jsonl")
    assert [r["section"] for r in files.sections(spark, f"{tmp_path}/s.jsonl", "CH1").collect()] == ["1.1"]
    assert files.sections(spark, f"{tmp_path}/s.jsonl", "ch1").count() == 0 and files.sections(spark, f"{tmp_path}/s.jsonl", "ch1", True).count() == 1
    (tmp_path / "texts").mkdir()
    for name, body in {"one.txt": "a\nb", "第二章.txt": "c", "else.txt": "d"}.items():
        (tmp_path / "texts" / name).write_text(body)
    got = files.chapter_texts(spark, f"{tmp_path}/texts", {"one.txt": "CH01", "第二章.txt": "CH02", "gone.txt": "CH03"}).collect()
    assert {tuple(r) for r in got} == {("CH01", "a\nb"), ("CH02", "c")}
    assert files.chapter_texts(spark, f"{tmp_path}/none", {}).collect() == []
    up = spark.createDataFrame([("a", "", "b", ""), ("", None, "c", "EXTENDS")], "source_kp_id string, source string, target string, type string")
    assert {tuple(r) for r in files.uploaded_relations(up).collect()} == {("a", "b", "RELATED", ""), (None, "c", "EXTENDS", "")}


def test_lookups(spark):
    e = spark.createDataFrame([("J1", 1, "uploaded"), ("J1", 2, "extracting"), ("J2", 3, "failed")], "job_id string, seq int, status string")
    assert review.job_status(e, "J1").first()["status"] == "extracting" and review.job_status(e, "J9").collect() == []
    assert [review.preview(spark.range(300), n).count() for n in (0, 7, 900)] == [1, 7, 200]
    ok = spark.createDataFrame([("a",), (None,)], "x string")
    assert store.assert_not_null(ok.where("x is not null"), "x").count() == 1
    with pytest.raises(ValueError, match="nulls"):
        store.assert_not_null(ok, "x")
    kps = spark.createDataFrame([("K1", "指针"), ("K2", "数组")], "kp_id string, name string")
    g = graph.Graph(kps.limit(0), kps, kps.limit(0), kps.limit(0))
    row = graph.explain_lookup(g, "K1").first()
    assert row["name"] == "指针" and '"kp_id":"K1"' in row["properties"] and graph.explain_lookup(g, "K9").collect() == []


def test_gates(spark):
    scored = spark.createDataFrame([(1, 64, None), (2, 65, None), (3, 100, "empty_name")], "i int, quality_score int, quality_hard_reject string")
    good, bad = quality.gate(scored)
    assert [r["i"] for r in good.collect()] == [2] and sorted(r["i"] for r in bad.collect()) == [1, 3]
    rows = [(1, "s", " 指针 变量 ", "memory", LONG, None), (2, "s", "指针变量", "memory", LONG, None), (3, "s", "数组", "memory", "short", None), (4, "s", "数组排列", "memory", LONG, "K1"), (5, "t", "循环嵌套", "control", LONG, "")]
    kept = quality.postprocess(spark.createDataFrame(rows, "ord int, section_key string, name string, category string, description string, duplicate_of string")).collect()
    assert sorted((r["ord"], r["name"], r["candidate_type"]) for r in kept) == [(1, "指针变量", "KnowledgePoint"), (5, "循环嵌套", "KnowledgePoint")]


def test_answers(spark):
    one = lambda name, description=LONG: f'{{"name": "{name}", "aliases": ["甲", "甲"], "category": "memory", "description": "{description}"}}'
    answers = [("S1", f"text before [{one('指针')}, {one('')}, {one('数组', 'short')}, {one('字符串')}, {one('结构体')}] after"), ("S2", "no list")]
    got = extract.candidates(spark.createDataFrame(answers, "_section_key string, text string")).collect()
    assert [(r["_section_key"], r["name"], r["aliases"]) for r in sorted(got, key=lambda r: r["ord"])] == [("S1", "指针", "甲"), ("S1", "字符串", "甲")]
    by_chapter = spark.createDataFrame([(f"S{c}", f"C{c}", f"[{one('指针')}]") for c in range(4)] + [("S5", None, f"[{one('指针')}]")], "_section_key string, chapter_id string, text string")
    allowed = extract.candidates(by_chapter, hints={"C0": ["memory", "syntax"], "C1": ["syntax"], "C2": []})
    assert sorted(r["_section_key"] for r in allowed.collect()) == ["S0", "S2", "S3", "S5"]
    p = spark.createDataFrame([('say {"a": "1", "b": ["x"]} end',), ('{"a": "1", "b": ["x",],}',), ("none",)], "t string")
    assert [r["p"] and (r["p"]["a"], r["p"]["b"]) for r in p.select(extract.payload(F.col("t"), "a string, b array<string>").alias("p")).collect()] == [("1", ["x"]), ("1", ["x"]), None]


def test_fused_sources(spark):
    d = spark.createDataFrame([("指针", "K1", 0), ("循环语句", "K2", 1)], "key string, value string, ordinal int")
    code = [("loop.c", None, None, "循环语句", "for (;;)", "code_ast", "c/loop.c", 1), (None, None, "Nothing", None, None, None, None, 2)]
    fused, entities = fuse.from_code(spark.createDataFrame(code, "subject_id string, subject_name string, object_name string, mapped_kp string, evidence string, source string, file_path string, ord int"), d)
    row = fused.first()
    assert fused.count() == 1 and (row["object_id"], row["predicate"], row["confidence"], row["file_path"], row["section_key"]) == ("K2", "IMPLEMENTS_KP", 0.9, "c/loop.c", "")
    assert {r["entity_name"] for r in entities.collect()} == {"loop.c", "unknown_code"}  # an entity, resolved or not
    gold = [("G1", "CH1", "1.1", "text", "why?", ["指针", "nothing"], [("prerequisite", "循环语句"), (" belongs_to_chapter ", "CH1"), ("", "x"), ("related", None)], 1), (None, "CH1", "1", "t", "q", ["指针"], [], 2)]
    ddl = "sample_id string, chapter_id string, section string, text_fragment string, question string, knowledge_points array<string>, relation_hints array<struct<type string, target string>>, ord int"
    fused, entities = fuse.from_gold(spark.createDataFrame(gold, ddl), d)
    assert {(r["predicate"], r["object_id"], r["object_type"], r["question"]) for r in fused.collect()} == {
        ("GOLD_LABEL", "K1", "KnowledgePoint", "why?"), ("PREREQUISITE", "K2", "KnowledgePoint", None), ("BELONGS_TO_CHAPTER", "CH1", "Chapter", None)}
    assert {(r["section_key"], r["confidence"], r["source"]) for r in fused.collect()} == {("CH1_1.1", 1.0, "gold_manual")}
    assert {(r["entity_id"], r["entity_type"]) for r in entities.collect()} == {("G1", "GoldSample"), ("CH1", "Chapter")}


def test_metrics(spark):
    raw = spark.createDataFrame([(1, "abcdef"), (2, "xy")], "doc_id int, text string")
    parts = spark.createDataFrame([(1, 1, False), (1, 1, True), (1, 2, False), (2, 2, False)], "doc_id int, level int, has_code boolean")
    got = text.result_metrics(raw, raw.withColumn("text", F.substring("text", 1, 2)), parts).collect()
    assert {tuple(r) for r in got} == {(1, 6, 2, 2, True), (2, 2, 2, 0, False)}
