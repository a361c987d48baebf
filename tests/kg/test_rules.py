"""Hand-made cases of rules that the tables don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.functions import scalars as s
from kgloom.operators import analytics, dedup, extract, fuse, graph, quality, resolve, review, store, text
from kgloom.sources import files


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], ddl).select(column.alias("r")).first()["r"]


def test_scalars(spark):
    c = F.col("v")
    for f, given, want in [
        (s.py_strip, "　 a b\t\n", "a b"), (s.norm_fuse, " A（b） C", "a(b)c"), (s.norm_rules, " A（b） C", "a（b）c"), (s.norm_name, " A（b） C", "A(b)C"), (s.norm_seed, "A b\tC", "ab\tc"),
        (s.slug, " a b/计(x)_", "a_b_计_x"), (s.slug, "  ", "unknown"), (s.literal, 'a"b\\c\nd', '"a\\"b\\\\c\\nd"'), (s.percent_path, "a b/ü~*", "a%20b/%C3%BC~%2A"),
        (s.predicate_name, "ALIAS", "aliasOf"), (s.predicate_name, "Odd", "odd"), (s.category, " 指针操作 ", "memory"), (s.category, "Loop things", "control"), (s.category, "zzz", "other"),
        (s.sentences, "a。 b \n。c！", ["a", "b", "c"]), (s.alias_list, "[ 'A b', \"ab\", c ,]", ["A b", "c"]), (s.clean_source, "#include <a.h>\nint x; // y", "\nint x; "),
    ]:
        assert one(spark, f(c), v=given) == want, (f.__name__, given)
    assert one(spark, s.jaccard_chars(F.col("a"), F.col("b")), a="abc", b="BCD") == 0.5
    assert one(spark, s.jaccard_chars(F.col("a"), F.col("b")), a="", b="") == 0.0
    assert one(spark, s.fuse_alias_ok(F.col("a"), F.col("e")), a="int", e="") is False and one(spark, s.fuse_alias_ok(F.col("a"), F.col("e")), a="数组名", e="x") is True
    assert one(spark, s.rule_alias_ok(F.col("a"), F.col("e")), a="abc", e="") is False and one(spark, s.rule_alias_ok(F.col("a"), F.col("e")), a="abcdef", e="") is True
    assert one(spark, s.head_mid_tail(F.col("v"), 6000), v="a" * 3000 + "b" * 3000 + "c" * 3000).startswith("a" * 2000 + "\n\n")
    fixed = one(spark, s.repair_json(c), v="```json\n{a: 'x', /* no */ b: [1,2,],}\n```").strip()
    assert fixed == '{"a": "x",  "b": [1,2]}'
    assert one(spark, s.payload_rows(c, "name string"), v="<think>[1]</think>```json\n[{\"name\": \"n\"}]```")[0]["name"] == "n"
    assert one(spark, s.payload_rows(c, "name string"), v="no") == []


def lines(spark, *texts):
    return text.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def result(df):
    return [r["line"] for r in df.orderBy("doc_id", "i").collect()]


def test_lines(spark):
    assert result(text.header_footer(lines(spark, "}\na\n}\nb\n}\nx=3.14\n第 3 页"))) == ["a", "b"]
    assert result(text.adjacent_dedup(lines(spark, "a\na \n\n\n[CODE_BLOCK_START]\nx\nx\n[CODE_BLOCK_END]\nb"))) == ["a", "", "", "[CODE_BLOCK_START]", "x", "x", "[CODE_BLOCK_END]", "b"]
    assert result(text.noise_filter(lines(spark, "a\n\n\n***\n\n12\nb"))) == ["a", "", "", "b"]
    assert one(spark, text.normalize_encoding(F.col("v")), v="Ａ（１）\r\n● b\t c—…") == "A(1)\n· b c-..."


def test_runs(spark):
    """Contents, broken lines, code blocks: runs of kinds of lines."""
    put = lambda kind, f, *ls: result(text.fold(lines(spark, "\n".join(ls)), kind, f))
    toc = lambda *ls: put(text.toc_kind, lambda x, kinds: [v for _, v in text.drop_toc(x, kinds)], *ls)
    entries = [f"节 {i} 标题....{i}" for i in range(8)]
    assert toc(*entries, "end") == [f"节 {i} 标题" for i in range(8)] + ["end"]
    assert toc("before", "", *entries[:6], "", "end") == ["before", *[f"节 {i} 标题" for i in range(6)], "end"]
    assert toc(*entries[:5], "end") == [*entries[:5], "end"]
    assert toc("one", *["x"] * 8, *entries[:4], *["y"] * 9) == ["one", *["x"] * 8, *entries[:4], *["y"] * 9]
    mend = lambda *ls: put(text.joint_kind, text.mend_breaks, *ls)
    assert put(text.page_kind, text.mend_pages, "Words of", "a page", *[f"{i} Title....{i}" for i in range(8)], "end") == ["Words of a page", *[f"{i} Title" for i in range(7)], "7 Title end"]
    assert mend("some words go", "on here-", "after", "", "Next.") == ["some words go on hereafter", "", "Next."]
    assert mend("exam-", "ple of") == ["example of"]
    assert mend("这是一个没有结束的", "中文句子。", "下一句") == ["这是一个没有结束的中文句子。", "下一句"]
    assert mend("这是一个", "第3章 标题。", "words", "1. item", "[CODE_BLOCK_START]") == ["这是一个", "第3章 标题。", "words", "1. item", "[CODE_BLOCK_START]"]
    assert mend("a" * 61, "more", "end;", "more") == ["a" * 61, "more end;", "more"]
    mark = lambda *ls: put(text.code_kind, text.mark_code, *ls)
    start, end = "[CODE_BLOCK_START]", "[CODE_BLOCK_END]"
    assert mark("text here that is long", "int main() {", "return x;", "}", "prose again is here") == ["text here that is long", start, "int main() {", "return x;", "}", end, "prose again is here"]
    assert mark("return x;", "prose again is here") == ["return x;", "prose again is here"]
    assert mark("int main() {", "", "", "return x;", "", "", "", "if (a) b;", "last words here") == [start, "int main() {", "", "", "return x;", end, "", "if (a) b;", "last words here"]
    assert mark("int main() {", "x", "", "y", "", "z", "", "return 0;") == [start, "int main() {", "x", "", "y", "", "z", end, "", "return 0;"]
    # lines behind a block: eight at most, one blank, no title
    call = "call_something(value)"
    assert mark("for(;;) {", "}", call, "", call, "", call) == [start, "for(;;) {", "}", call, "", call, end, "", call]
    assert mark("for(;;) {", "}", *[call] * 10) == [start, "for(;;) {", "}", *[call] * 8, end, call, call]
    assert mark("for(;;) {", "}", "1.2 title(with) brackets", call) == [start, "for(;;) {", "}", end, "1.2 title(with) brackets", call]
    # blocks that touch are one; an open marker of the text's own closes at the end
    assert mark("for(;;) {", "}", call, "for(;;) {", "}", "the last words here") == [start, "for(;;) {", "}", call, "for(;;) {", "}", end, "the last words here"]
    assert mark(start, "open words here") == [start, "open words here", end]


def test_ocr(spark):
    got = result(text.ocr_correction(lines(spark, "上\n/注释 /\nAB CD EF GH\n《x\nx = l0;\nif(a) |\nprint£(a)\nprinté $d\n[CODE_BLOCK_START]\nl\n|\n[CODE_BLOCK_END]"),
                                     text.Rules(prose=[("literal", "printé", "printf")])))
    assert got == ["", "/* 注释 */", "", "", "x = 10;", "if(a) {", "printf(a)", "printf %d", "[CODE_BLOCK_START]", "", "{", "[CODE_BLOCK_END]"]


def test_rule_tables(spark):
    start, end = "[CODE_BLOCK_START]", "[CODE_BLOCK_END]"
    rules = text.Rules(snippets=[("literal", "count ++", "count++")], inserts=[("if(n!=0){", "count++;", True, "}"), ("letter=%d", "}", False, "}")],
                       rebuilds=[("Example 3", ["bad"], ["good", "lines"])], style=[("regex", "^A if", "an if"), ("literal", "colour", "color")], starts=[("Exercise", "exercise:")], drops=["***"], samples=[("literal", "Enter n;", "Enter n:")])
    rows = lines(spark, "\n".join(["count ++", "Example 3", start, "ok", end, start, "bad", end, "Example 3", start, "bad", end, start, "count ++;", "", "if(n!=0){", "printf(letter=%d)", end]))
    repaired = result(text.snippet_repair(rows, rules))
    assert repaired == ["count ++", "Example 3", start, "ok", end, start, "good", "lines", end, "Example 3", start, "bad", end, start, "count++;", "", "}", "if(n!=0){", "}", "printf(letter=%d)", end]
    assert result(text.post_normalize(lines(spark, "A if\ncolour\nExercise 5\nExercise 6\n***\nEnter n;"), rules)) == ["an if", "color", "exercise:", "Enter n:"]


def test_clean_document(spark):
    """All steps, and the plan: an exchange by document at first and behind each of the two folds."""
    page = "第 3 页\n这是一个没有结束的\n中文句子。\nint main() {\nreturn l0;\n}\n***\n\n\n这是结尾的一句话。\n这是结尾的一句话。"
    docs = spark.createDataFrame([(1, page), (2, "only words")], "doc_id bigint, text string")
    out = text.clean_document(docs)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        1: "这是一个没有结束的中文句子。\n[CODE_BLOCK_START]\nint main() {\nreturn 10;\n}\n[CODE_BLOCK_END]\n这是结尾的一句话。", 2: "only words"}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(doc_id") == 3


def test_segments(spark):
    body = "x" * 30
    got = text.segments(lines(spark, f"pre\n第1章 开头部分\n{body}\n1.1 小节标题\nshort\n1.2 又一小节\n\n1.3 最后一节\n{body}", "no titles")).orderBy("doc_id", "seq").collect()
    assert [(r["section_id"], r["title"], r["text"]) for r in got] == [
        ("S00", "前言", "pre"), ("CH01", "第1章 开头部分", f"{body}\n1.1 小节标题\nshort"), ("CH01_02", "1.2 又一小节", ""), ("CH01_03", "1.3 最后一节", body), ("S01", "全文", "no titles")]
    parts = text.corpus_sections(lines(spark, "intro\n1.1 题目\nt\n[CODE_BLOCK_START]\nint x;\n[CODE_BLOCK_END]\n2.1 别章\n1.2 节中介绍\n[CODE_BLOCK_START]\nlost"), 1).orderBy("seg").collect()
    assert [(r["section"], r["title"], r["text"], r["code_blocks"]) for r in parts] == [("1.0", "章节引言", "intro", []), ("1.1", "题目", "t\n2.1 别章\n1.2 节中介绍", ["int x;"])]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "RELATED"), ("b", "a", "RELATED"), ("a", "a", "RELATED")], "src string, dst string, type string")
    kps = spark.createDataFrame([("a", None, "CH01", "10.1", "xq", "s"), ("b", "bq", "CH01", "2.1", None, "s")], "kp_id string, name string, chapter_id string, section string, aliases string, source string")
    ch = spark.createDataFrame([("CH01", "t", 1)], "chapter_id string, title string, `order` bigint")
    ex = spark.createDataFrame([], "example_id string, name string, chapter_id string")
    g = graph.Graph(ch, kps, ex, e)
    assert [r["kp_id"] for r in graph.undirected_neighbors(g, "a").collect()] == ["a", "b", "b"]
    assert [r["kp_id"] for r in graph.search_kps(g, "q").collect()] == ["a", "b"]
    assert [r["kp_id"] for r in graph.search_kps(g, "bq").collect()] == ["b"]
    assert graph.stats(graph.Graph(ch.limit(0), kps, ex, e)).first()["total_kps"] == 0
    cycle = spark.createDataFrame([("r", "x"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    got = {r["node"]: r["depth"] for r in analytics.layer_depth(analytics.backbone(cycle), cycle).collect()}
    assert got == {"r": 0, "x": 1, "y": 1, "z": 1}
    reach = analytics.reachable(cycle, spark.createDataFrame([("x",)], "node string")).collect()
    assert {(r["node"], r["distance"]) for r in reach} == {("y", 1), ("x", 2), ("z", 2)}


def test_dedup(spark):
    rows = spark.createDataFrame([(1, "A", "abcd"), (2, "A", "abce"), (3, "A", "abcde"), (4, "B", "abcde"), (5, "B", "abcd"), (6, "B", "zz")], "ord bigint, section_key string, name string")
    kept = [r["ord"] for r in dedup.greedy(rows).orderBy("ord").collect()]
    assert kept == [1, 2, 4, 6]  # abcde is near abcd in A (0.8); B keeps it, and drops abcd as an equal name
    d = dedup.dictionary(spark.createDataFrame([("k", "1", 0), ("m", "2", 1), ("k", "3", 2)], "key string, value string, ord bigint")).orderBy("ordinal").collect()
    assert [(r["key"], r["value"]) for r in d] == [("k", "3"), ("m", "2")]
    assert dedup.pass_rate(spark.createDataFrame([], "passed boolean")).first()["pass_rate"] == 0.0


def test_resolve(spark):
    texts = spark.createDataFrame([(1, "a+b is aba"), (2, None), (3, "")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("a+b",), ("ab",), ("b",), ("is",)], "term string")
    want = {(1, "a+b"), (1, "ab"), (1, "is")}
    hits = resolve.term_hits(texts, terms)
    assert sorted(tuple(r) for r in hits.collect()) == sorted(want)
    for plan in (hits, resolve.duplicate_of(terms.select(F.col("term").alias("name")), terms.select(F.col("term").alias("seed"), F.lit("v").alias("value"), F.lit(1).alias("ordinal")), s.norm_seed)):
        assert "NestedLoop" not in plan._jdf.queryExecution().toString()
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab😀é\n") for _ in range(n))
    many = [(i, word(rng.randrange(40))) for i in range(60)]
    words = sorted({word(rng.randrange(1, 7)) for _ in range(80)})
    for most in (resolve.HELD, 3):
        got = resolve.term_hits(spark.createDataFrame(many, "doc_id bigint, text string"), spark.createDataFrame([(w,) for w in words], "term string"), 1, most)
        assert sorted(tuple(r) for r in got.collect()) == sorted((i, w) for i, x in many for w in words if w in x)
    assert resolve.term_hits(texts, terms.limit(0)).collect() == []
    d = spark.createDataFrame([("array", "K1", 0), ("ray", "K2", 1)], "key string, value string, ordinal bigint")
    got = {r["name"]: r["resolved"] for r in resolve.resolve(spark.createDataFrame([("Ray",), ("arr",), ("xrayx",), ("ar",), ("",)], "name string"), d, s.norm_rules, 3).collect()}
    assert got == {"Ray": "K2", "arr": "K1", "xrayx": "K2", "ar": None, "": None}


def test_extract(spark):
    sec = spark.createDataFrame([("S1", "t", "理解指针是数组的基础。指针(pointer)，指针又称地址量", ["for (;;) printf(x); for(;;)"])], "section_key string, title string, text string, code_blocks array<string>")
    d = spark.createDataFrame([("指针", ("K1", "指针"), 0), ("数组", ("K2", "数组"), 1)], "key string, value struct<kp_id:string,name:string>, ordinal bigint")
    p = extract.prerequisites(sec, d).collect()
    assert ("K1", "K2") in {(r["subject_id"], r["object_id"]) for r in p}
    assert {r["object_name"] for r in extract.aliases(sec, d).collect()} == {"pointer", "地址量"}
    assert [r["object_name"] for r in extract.code_hints(sec).orderBy("ord").collect()] == ["for语句", "格式化输入输出"]
    src = spark.createDataFrame([("c/x.c", "int f(int n) { do { f(n-1); } while (n); }")], "file_path string, source string")
    assert {r["object_name"] for r in extract.code_triples(src).collect()} == {"DoWhile", "Recursion"}
    assert {r["object_name"] for r in extract.code_triples(src, parse=False).collect()} == {"DoWhile", "While", "Recursion"}
    prompts = spark.createDataFrame([("a", "p" * 80), ("b", "short"), ("c", "x" * 90)], "_section_key string, prompt string")

    def client():
        calls = []

        def send(prompt):
            calls.append(prompt)
            if prompt[0] == "x":
                raise ValueError("down")
            return f"[{len(calls)}]"

        return send

    got = {r["_section_key"]: (r["text"], r["error"]) for r in extract.ask(prompts, client).collect()}
    assert got["a"][0].startswith("[") and got["c"] == (None, "down") and "b" not in got


def test_quality(spark):
    base = ("n1 指针", "syntax", "s" * 12, "d" * 40, "code", None, None, 0.0)
    ddl = "name string, category string, summary string, description string, code_example string, candidate_type string, duplicate_of string, near double"
    rows = [base, ("", *base[1:]), (*base[:3], "d" * 19, *base[4:]), (*base[:3], "d" * 20, *base[4:]), ("循环结构", "odd", "", "d" * 40, "", None, "K", 0.9)]
    got = [(r["quality_score"], r["quality_hard_reject"]) for r in quality.score(spark.createDataFrame(rows, ddl)).collect()]
    assert got == [(100, None), (0, "empty_name"), (88, "description_too_short"), (88, None), (0, "generic_name")]


def test_store_and_review(spark):
    base = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "id string, name string, other string")
    rows = spark.createDataFrame([("a", "z", 1), ("a", None, 2), ("c", "w", 1)], "id string, name string, ord bigint")
    once = store.merge_nodes(base, rows, "id", ["name"])
    assert {tuple(r) for r in once.collect()} == {("a", None, "1"), ("b", "y", "2"), ("c", "w", None)}
    assert {tuple(r) for r in store.merge_nodes(once, rows, "id", ["name"]).collect()} == {tuple(r) for r in once.collect()}
    with pytest.raises(ValueError):
        store.assert_unique(rows, ["id"])
    with pytest.raises(ValueError):
        store.of_types(rows.withColumn("type", F.lit("X")), ["X"])
    log = spark.createDataFrame([("r1", 1, "pending"), ("r1", 2, "approved"), ("r1", 3, "rejected"), ("r1", 4, "approved"), ("r2", 1, "pending")], "id string, seq bigint, status string")
    assert {r["id"]: r["status"] for r in review.latest(log).collect()} == {"r1": "rejected", "r2": "pending"}
    items = spark.createDataFrame([(1, "update", "q", "u"), (2, "add", "q", "v"), (3, "delete", "a", None)], "seq bigint, action string, id string, name string")
    end = review.replay(base.select("id", "name"), items, "id", ["name"])
    assert {tuple(r) for r in end.collect()} == {("b", "y"), ("q", "v")}


def test_fuse(spark):
    d = spark.createDataFrame([("ptr", "K1", 0)], "key string, value string, ordinal bigint")
    t = spark.createDataFrame([("MENTIONS_KP", None, "S 1", None, "PTR", "e", "text_rule", "S 1", 0), ("PREREQUISITE", "K1", "p", "K1", "p", "e", "text_rule", "S 1", 1), ("ALIAS", "K1", "p", None, "pointer", "e", "text_rule", "S 1", 2),
                               ("OTHER", None, None, None, None, None, None, None, 3)], "predicate string, subject_id string, subject_name string, object_id string, object_name string, evidence string, source string, section_key string, ord bigint")
    fused, entities = fuse.from_text(t, d)
    assert {(r["subject_id"], r["predicate"], r["object_id"], r["confidence"]) for r in fused.collect()} == {("SEC_S_1", "MENTIONS_KP", "K1", 0.75), ("ALIAS_K1_pointer", "ALIAS", "K1", 0.88)}
    assert {r["entity_id"] for r in entities.collect()} == {"SEC_S_1", "SEC_UNKNOWN", "ALIAS_K1_pointer"}


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("source_kp_id,target_kp_id,relation_type,description\na,b,RELATED,uses #include\n# all\n,c,RELATED,x\n")
    assert [tuple(r) for r in files.relations_csv(spark, str(tmp_path / "r.csv")).collect()] == [("a", "b", "RELATED", "uses ")]
    (tmp_path / "k.csv").write_text("﻿kp_id,section\nK1,1.10\nK2,\n", encoding="utf-8")
    assert {tuple(r) for r in files.csv(spark, str(tmp_path / "k.csv"), ["kp_id", "section", "none"]).collect()} == {("K1", "1.10", ""), ("K2", "", "")}
    assert files.csv(spark, str(tmp_path / "no.csv"), ["a"]).count() == 0
    (tmp_path / "n.csv").write_text("a,b\n1,2,3\n4\n")
    assert [tuple(r) for r in files.naive_csv(spark, str(tmp_path / "n.csv")).collect()] == [("1", "2")]
    df = spark.createDataFrame([("x", None)], "a string, b string")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert [tuple(r) for r in files.jsonl(spark, str(tmp_path / "out"), "a string, b string").collect()] == [("x", None)]
    files.write_turtle(spark.createDataFrame([(2, "b", "l2"), (1, "a", "l1")], "part int, key string, line string"), str(tmp_path / "ttl"), fuse.BASE_URI)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "ttl")).collect()][2:] == ["l1", "l2"]
    kinds = spark.createDataFrame([("kp_relations.csv",), ("chapter_kp.csv",), ("edges.csv",), ("x.csv",)], "n string").select(files.upload_kind(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["kp", "chapter", "relation", None]


def test_stream(spark, tmp_path):
    from kgloom.streaming.review_log import latest_status

    rows = [("r1", 1, "pending", "2024-01-01 00:00:00"), ("r1", 2, "approved", "2024-01-01 00:01:00"), ("r1", 2, "approved", "2024-01-01 00:01:00"), ("r2", 1, "rejected", "2024-01-01 00:02:00")]
    ddl = "id string, seq bigint, status string, at string"
    spark.createDataFrame(rows, ddl).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).json(str(tmp_path / "in")).withColumn("at", F.to_timestamp("at"))
    q = latest_status(stream).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("latest").collect():
        got[r["id"]] = r["status"]
    assert got == {"r1": "approved", "r2": "rejected"}


def test_ask_again(spark):
    """Refused answers are asked for again, then an error; a list of models goes on to the next one for its own errors only."""
    from kgloom.operators import extract

    def client():
        asked = {}

        def send(prompt):
            asked[prompt] = asked.get(prompt, 0) + 1
            return "no" if prompt.startswith("b") or asked[prompt] == 1 else "[1]"

        return send

    prompts = spark.createDataFrame([("1", "a" * 80), ("2", "b" * 80), ("3", "short")], "_section_key string, prompt string").coalesce(1)
    got = {r["_section_key"]: (r["text"], r["error"]) for r in extract.ask(prompts, client, usable=lambda t: t.startswith("["), pause_s=0.01).collect()}
    assert got == {"1": ("[1]", None), "2": (None, "no usable answer")}

    def open_(model):
        def send(prompt):
            if model == "none":
                raise KeyError("No such model")
            if prompt == "bad":
                raise ValueError("refused")
            return f"{model}: {prompt}"

        return send

    send = extract.first_of(["none", "two", "none"], open_, lambda e: isinstance(e, KeyError))()
    assert send("x") == "two: x" and send("y") == "two: y"
    with pytest.raises(ValueError, match="refused"):
        send("bad")


def test_review_states(spark):
    """An approval counts while pending, a rejection always, whatever came before."""
    from kgloom.operators import review

    runs = {"a": ["pending", "approved"], "b": ["rejected", "approved"], "c": ["pending", "approved", "rejected", "approved"], "d": ["approved"], "e": ["rejected", "pending", "approved"], "f": ["approved", "pending"]}
    events = spark.createDataFrame([(k, i, s_) for k, xs in runs.items() for i, s_ in enumerate(xs)], "id string, seq bigint, status string")
    assert {r["id"]: r["status"] for r in review.latest(events).collect()} == {"a": "approved", "b": "rejected", "c": "rejected", "d": "approved", "e": "approved", "f": "pending"}
    assert [review.takes(F.lit(x)) is not None for x in ("a.PDF",)] == [True]
    assert spark.range(1).select(review.takes(F.lit("a.PDF")), review.takes(F.lit("a.txt")), review.takes(F.lit(None).cast("string"))).first()[:] == (True, False, False)


def test_prompts(spark):
    from kgloom.functions import prompts

    one_ = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one_(prompts.extraction("{title}|{text}|{code}|{names}", F.lit("T"), F.lit("x" * 2000), F.array(F.lit("a" * 700), F.lit("b"), F.lit("c")), [str(i) for i in range(50)])) == f"T|{'x' * 1500}|{'a' * 600}\n\nb|{'、'.join(str(i) for i in range(40))}"
    import re
    assert re.fullmatch("20240102030405_[0-9a-f]{8}", one_(prompts.job_id(F.lit("2024-01-02 03:04:05").cast("timestamp"))))


def test_long_lists(spark):
    """Names meet a long list through its characters, with the same similarities."""
    from kgloom.operators import dedup

    names = ["abc", "ABD", "xyz", "", "aabbcc"]
    a = spark.createDataFrame([(x,) for x in names], "a string")
    b = spark.createDataFrame([(x,) for x in ["ab", "cba", "q"]], "b string")
    every = {(r["a"], r["b"]): r["similarity"] for r in dedup.name_overlaps(a, b).collect()}
    some = {(r["a"], r["b"]): r["similarity"] for r in dedup.name_overlaps(a, b, 2).collect()}
    assert some == every and len(every) == 6 and all(every.values())


def test_duplicates_of_empty(spark):
    from kgloom.operators import resolve

    seeds = spark.createDataFrame([("Array", "K2", 2), ("Pointer", "K1", 1), (" ", "K9", 9)], "seed string, value string, ordinal int")
    names = spark.createDataFrame([("arr ay list",), ("point",), ("other",), ("",)], "name string")
    assert {r["name"]: r["duplicate_of"] for r in resolve.duplicate_of(names, seeds, s.norm_seed).collect()} == {"arr ay list": "K2", "point": "K1", "other": "K9", "": "K1"}
    assert {r["duplicate_of"] for r in resolve.duplicate_of(names, seeds.where("ordinal = 2"), s.norm_seed).collect()} == {"K2", None}


def test_cheap_tests_before_patterns(spark):
    """What spares patterns changes nothing: white space of every kind, signs of code in either case and in letters that count as others, texts within and beyond ASCII."""
    from kgloom.functions import tables as t
    from kgloom.functions.scalars import py_strip

    same = lambda df, a, b: df.where(~a.eqNullSafe(b)).collect()
    line = F.col("line")
    spaces = spark.range(0x110000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c")).select(F.concat("c", F.lit("a"), "c", F.lit("b "), "c", "c").alias("line"))
    assert same(spaces, py_strip(line), F.regexp_replace(line, r"(?U)^\s+|\s+$", "")) == []
    parts = ["#include", "VOID x", "voıd x", "int maİn", "return 1", "RETURN  y", "caſe x", "elſe  if", "break ;", "continue", "++i", "++ I", "print f(", "if (", "{", " }x", "a=b|", "(x |", "7%", "7 *", "x += 1;", "x+=1", "y--;",
             '"%d"', '"a" %s "', '100%"', "printl", "print$", "$lf %$d", "pрint£", "HELLO WORLD", "ÀÉÎ ÕÜ", "《x》", "中文 and", " ", "\t", "  ", "\x00\x07", "\r\n", "\r", "…⋯", "“q”", "Ａ１", "　", "● x", "©  y", "— –"]
    ls = spark.createDataFrame([(a + x + b,) for a in parts for x in ("", " ", "\n") for b in parts], "line string")
    bare = py_strip(line)
    assert same(ls, text.looks_like_code(line), (bare != "") & (F.startswith(line, F.lit("    ")) | F.startswith(line, F.lit("\t")) | text._found(bare, t.CODE_SIGNS))) == []
    n = F.greatest(F.length(line), F.lit(1))
    odd, capitals = F.length(F.regexp_replace(line, "[\\x00-\\x7F]", "")), F.length(F.regexp_replace(line, "[^\\p{IsUppercase} ]", ""))
    assert same(ls, text.garbled(line), (F.length(bare) > 5) & (odd < 0.1 * n) & (capitals > 0.5 * n) & ~F.regexp_like(line, F.lit("[a-z]{3,}"))) == []
    out = F.regexp_replace(F.regexp_replace(line, "\r\n?", "\n"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    out = F.translate(out, text.FULL + "　“”‘’", text.HALF + " \"\"''")
    out = F.regexp_replace(F.regexp_replace(out, "[‒–—―﹘]", "-"), "[…⋯]{1,2}", "...")
    assert same(ls, text.normalize_encoding(line), F.regexp_replace(F.regexp_replace(out, r"(?mU)^[。©◎○●□▪▸]\s+", "· "), "[ \t]+", " ")) == []


def test_cleaning_strips_lines_without_a_pattern(spark):
    """Lines are stripped many times over; a pattern for it took a good part of the time."""
    plan = text.clean_document(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)^\s+|\s+$") <= 2  # a rule of code, in both corrections
