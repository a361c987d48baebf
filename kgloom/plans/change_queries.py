"""Imports, applied changes and code syntax over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, tables
from ..functions import scalars as s
from ..operators import apply, dedup, extract, fuse, imports, resolve, review, store, text
from ..operators import graph as g
from . import graphview as v
from .graphview import read
from .record_queries import TRIPLES, _triples

NODE = "KP000031"


def _parts(df: DataFrame) -> DataFrame:
    """Chapters, nodes and relations of each document as rows (doc_id, kind, a, b, c), in one pass: their rules run over a text once."""
    def rows(column, kind, *fields):
        return F.coalesce(F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), *[x[f].cast("string").alias(n) for n, f in zip("abc", fields, strict=True)])), F.array())

    parts = F.concat(rows("chapters", "chapter", "chapter_id", "title", "order"), rows("kps", "kp", "kp_id", "name", "chapter_id"), rows("relations", "relation", "source", "target", "description"))
    return df.select("doc_id", F.inline(parts))


def _payloads(spark, d):
    """An answer for each region: its nations are chapters that list suppliers. Every third nation lists them one level deeper, every
    fifth has no name; regions 3 and 4 have nodes of their own, 4 no chapters."""
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(F.lit(" "), x["s_name"])).alias("names"))
    n = read(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    name = F.when(F.col("n_nationkey") % 5 != 2, F.col("n_name"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    deep = F.to_json(F.struct(name.alias("chapter"), F.array(F.struct(F.lit("").alias("chapter_key"), F.lit(None).cast("string").alias("title"), names.alias("keypoints")),
                                                                      F.struct(F.lit(None).cast("string").alias("chapter_key"), F.lit("extra").alias("title"), F.array(F.lit(" "), F.lit("last")).alias("keypoints"))).alias("chapters")))
    flat = F.to_json(F.struct(name.alias("chapter_key"), names.alias("keypoints")))
    n = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, deep).otherwise(flat).alias("j")))), lambda x: x["j"]), ",").alias("c"))
    own = F.when(F.col("n_regionkey") >= 3, F.lit(', "kps": [{"kp_id": "K1", "name": "own", "chapter_id": "C1", "source": "x"}], "relations": [{"source": "K1", "target": "K2", "relation_type": "EXTENDS", "description": "own"}]')).otherwise("")
    text = F.concat(F.lit('{"chapter": "root", "chapters": ['), F.when(F.col("n_regionkey") == 4, "").otherwise(F.col("c")), F.lit("]"), own, F.lit("}"))
    return n.select(F.col("n_regionkey").cast("bigint").alias("doc_id"), F.from_json(text, imports.PAYLOAD).alias("payload"))


def _subject_texts(spark, d):
    """Documents with chapter lines and lines that name subjects put in front of some of them."""
    i = F.col("doc_id")
    head = F.when(i % 3 == 0, F.concat(F.lit("第 "), (i % 9 + 1).cast("string"), F.lit(" 章 开头\n变量 "), (i % 7).cast("string"), F.lit("\n第二章 后面\n 数组与指针 \n变量 "), (i % 7).cast("string"), F.lit("\n函数\n"))).when(i % 3 == 1, F.lit("文件\n")).otherwise("")
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.concat(head, "text").alias("text"))


def _candidate_json(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("", ', "candidate_type": null', ', "candidate_type": "MethodPattern"', ', "candidate_type": "KnowledgePoint"')]), (F.col("event_id") % 4 + 1).cast("int"))
    dup = F.element_at(F.array(*[F.lit(x) for x in ("", ', "duplicate_of": null', ', "duplicate_of": "KP1"')]), (F.col("event_id") % 3 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", F.concat(F.lit('{"name": "x"'), kind, dup, F.lit("}")).alias("json"))


def _sections(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("_section_key"), "text")


def _found(spark, d):
    return read(spark, d, "labels").select(F.col("doc_id").alias("_section_key"), F.when(F.col("toxic") == 1, "KP1").alias("duplicate_of"))


def _applied(spark, d, mode="append"):
    """Every event is a change: of chapters, nodes with a part's number and relations between them; the graph before is nations and parts."""
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("REV"), F.col("event_id").cast("string")).alias("id"), (F.col("user_id") % 300).alias("u"), "event_id")
    kind = F.when(F.col("event_id") % 7 == 0, "chapter").when(F.col("event_id") % 7 < 4, "relation").otherwise("kp")
    action = F.when(kind == "relation", "add").when(F.col("event_id") % 5 == 0, "delete").when(F.col("event_id") % 3 == 0, "update").otherwise("add")
    kp, chapter = v._key("KP", F.col("u"), 6), v._key("CH", F.col("u") % 28, 2)
    mark = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    maps = {
        "chapter": F.create_map(F.lit("chapter_id"), chapter, F.lit("title"), mark, F.lit("order"), F.col("event_id").cast("string")),
        "relation": F.create_map(F.lit("source"), kp, F.lit("target_kp_id"), v._key("KP", F.col("event_id") % 290, 6), F.lit("type"), F.when(F.col("event_id") % 2 == 0, "EXTENDS").otherwise("RELATED"), F.lit("description"), mark),
        "kp": F.create_map(F.lit("kp_id"), kp, F.lit("name"), mark, F.lit("chapter_id"), chapter, F.lit("section"), F.when(F.col("event_id") % 4 == 0, mark), F.lit("aliases"), F.lit("a"),
                           F.when((F.col("event_id") % 6 == 1), "other").otherwise("source"), mark),
    }
    items = e.select("seq", "id", kind.alias("type"), action.alias("action"), F.when(kind == "chapter", maps["chapter"]).when(kind == "relation", maps["relation"]).otherwise(maps["kp"]).alias("data"))
    x = v.graph(spark, d)
    return apply.apply_reviewed(x.chapters.select("chapter_id", "title", "order"), x.kps.select("kp_id", *apply.KP_COLUMNS), x.edges.withColumn("description", F.lit("base")), items, mode)


def _apply_nodes(spark, d):
    c, k, _, failed = _applied(spark, d)
    return c.select(F.lit("chapter").alias("kind"), F.col("chapter_id").alias("id"), F.col("title").alias("a"), F.col("order").cast("string").alias("b")).unionAll(
        k.select(F.lit("kp"), "kp_id", "name", F.concat_ws("|", "chapter_id", F.coalesce("section", F.lit("-")), "aliases", "source"))).unionAll(failed.select(F.lit("failed"), "id", "error", F.lit(None).cast("string")))


def _edits(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("ord"), F.element_at(F.array(F.lit("add"), F.lit("update"), F.lit("delete")), (F.col("event_id") % 3 + 1).cast("int")).alias("action"), v._key("KP", F.col("user_id"), 6).alias("kp_id"),
                                        F.create_map(F.lit("name"), F.col("event_type"), F.lit("section"), F.when(F.col("event_id") % 4 == 0, "s")).alias("data"))
    return apply.kp_edits(e).select("ord", "action", "source", F.array_join(F.transform(F.array_sort(F.map_keys("data")), lambda k: F.concat_ws("=", k, F.element_at("data", k))), ";").alias("data"))


def _confirmed(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.create_map(F.lit("kp_id"), v._key("KP", F.col("p_partkey"), 6), F.lit("status"), F.when(F.col("p_partkey") % 3 == 0, "update").otherwise("new")).alias("data"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.create_map(F.lit("source"), v._key("KP", F.col("s_suppkey"), 6)).alias("data"))
    q = review.numbered(apply.confirm_import(p, s))
    return q.select("id", "type", "action", "status", F.coalesce(F.element_at("data", "kp_id"), F.element_at("data", "source")).alias("node"))


def _labelled(spark, d):
    k = v.graph(spark, d).kps.select("kp_id", "name", F.when(F.col("source_page") % 2 == 0, F.array(F.lit("KnowledgePoint"), F.lit("Entity"))).otherwise(F.array(F.lit("KnowledgePoint"))).alias("labels"))
    rows = read(spark, d, "orders").groupBy(v._key("KP", F.col("o_custkey"), 6).alias("kp_id")).agg(F.max("o_orderkey").alias("ord")).select("kp_id", F.concat(F.lit("o"), F.col("ord").cast("string")).alias("name"), "ord")
    merged, bad = store.merge_labelled(k, rows, "kp_id", ["name"], ["KnowledgePoint", "Entity"])
    return merged.select(F.lit("node").alias("kind"), "kp_id", "name", F.array_join("labels", ",").alias("labels")).unionAll(bad.select(F.lit("violation"), "kp_id", F.lit(None).cast("string"), F.lit(None).cast("string")))


#: Sources with what each has by syntax; the last has brackets that don't match, and goes by its text.
PROGRAMS = [
    ('int f(int n) { /* while (1) */ return n < 2 ? 1 : f(n - 1); } // for (', ["Recursion"]),
    ('#define for while (\nint main() { char *s = "while ("; do { printf("%d", 1); } while (x); }', ["DoWhile", "Printf"]),
    ("void a() { for (;;) while (b()) c(); } int main() { scanf(p); switch (x) { } quick_sort(v); }", ["BubbleSort", "For", "Scanf", "Switch", "While"]),
    ("int g(int n); int main() { int g(int); MALLOC(3); Free(p); do if (a) b(); else c(); while (d); while (e); }", ["DoWhile", "Free", "Malloc", "While"]),
    ("while (x) { do {", ["DoWhile", "While"]),
]


def _programs(spark, d):
    """Every page is a comment behind one of the programs, but for that whose text counts."""
    p = F.element_at(F.array(*[F.lit(x) for x, _ in PROGRAMS]), (F.col("page_id") % len(PROGRAMS) + 1).cast("int"))
    p = F.concat(p, F.when(F.col("page_id") % len(PROGRAMS) < len(PROGRAMS) - 1, F.concat(F.lit("\n/* "), F.replace("html", F.lit("*/"), F.lit("")), F.lit(" */"))).otherwise(""))
    return read(spark, d, "pages").select("page_id", F.array_join(extract.code_patterns(p), ",").alias("patterns"))


def _prompts(spark, d):
    c = read(spark, d, "conversations")
    related = F.when(F.col("turn") % 2 == 0, F.array(F.col("role"), F.lit("x")))
    return c.select("conv_id", "turn", prompts.chat(F.col("text"), related, F.when(F.col("turn") % 3 == 0, "CH01")).alias("prompt"))


def _code_parts(spark, d):
    c = read(spark, d, "conversations")
    text = F.concat(F.lit("see ```c\nint x;\n``` or ```"), "role", F.lit("``` "), "text")
    return c.select("conv_id", "turn", F.posexplode(prompts.code_parts(text)).alias("i", "x")).select("conv_id", "turn", "i", "x.lang", "x.code")


def _seeds(spark, d):
    return read(spark, d, "nation").select(F.initcap("n_name").alias("seed"), F.col("n_nationkey").cast("string").alias("value"), F.col("n_nationkey").alias("ordinal"))


def _duplicates(spark, d):
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    names = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(" ", F.col("n_name"), (F.col("c_custkey") % 3).cast("string")).alias("name")).unionAll(c.select(F.col("c_name").alias("name")))
    return resolve.duplicate_of(names.distinct(), _seeds(spark, d), s.norm_seed)


def _canonical(spark, d):
    p = read(spark, d, "part")
    names = p.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(F.concat("p_name", F.lit("?"))).alias("name"), "p_partkey")
    return resolve.canonical(names, p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal")), s.norm_fuse)


def _reviews(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("REV"), F.col("event_id").cast("string")).alias("id"), F.element_at(F.array(F.lit("pending"), F.lit("approved")), (F.col("event_id") % 2 + 1).cast("int")).alias("status"), F.struct(F.col("event_type").alias("name")).alias("data"))
    return review.by_status(e, "approved", "99").unionAll(review.by_status(e, "all", "purchase")).select("id", "status", "data.name")


def _lines(spark, d):
    return text.lines(read(spark, d, "documents"))


def _fused_edges(spark, d):
    t = _triples(spark, d).where("object_id is not null").select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.lit("FUSED_RELATION").alias("type"), "predicate", "object_id", "source", "section_key", "evidence", "ord")
    key = ["src", "dst", "type", "predicate", "object_id", "source"]
    base = t.groupBy(*key).agg(F.lit("before").alias("section_key"), F.lit(None).cast("string").alias("evidence"))  # of each edge, as a load before left it
    fresh = t.where("ord % 3 <> 0")  # edges that no fresh row writes keep what they have
    return store.merge_fused(base, fresh).select("src", "dst", "predicate", "source", "section_key", "evidence")


def _entities(spark, d):
    base = read(spark, d, "nation").select(F.concat(F.lit("E"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("name"), F.lit("old").alias("note"))
    rows = read(spark, d, "supplier").select(F.concat(F.lit("E"), (F.col("s_suppkey") % 40).cast("string")).alias("entity_id"), F.col("s_name").alias("name"), F.nullif(F.col("s_name"), F.col("s_name")).alias("note"), F.col("s_suppkey").alias("ord"),
                                             F.element_at(F.array(F.lit("KnowledgePoint"), F.lit("Chapter"), F.lit("Pattern")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("entity_type"))
    return store.upsert_other(base, rows, "entity_id", ["name", "note"], ["KnowledgePoint", "Chapter"])


def _loaded(spark, d):
    x = v.graph(spark, d)
    rows = x.edges.withColumn("type", F.when(F.col("type") == "EXAMPLE_OF", "OTHER").otherwise(F.col("type")))
    ok, rest = store.link(store.of_types(rows, ["CONTAINS", "RELATED"]), x.kps.select(F.col("kp_id").alias("id")), x.kps.where("source_page > 10").select(F.col("kp_id").alias("id")))
    return ok.select(F.lit("linked").alias("kind"), "src", "dst", "type").unionAll(rest.select(F.lit("lost"), "src", "dst", "type"))


def _events_stream(spark, d):
    e = read(spark, d, "events")
    return extract.sse_data(e.select(F.col("event_id").alias("i"), F.when(F.col("event_id") % 5 == 1, "").when(F.col("event_id") == 900, "data: [DONE]").otherwise(F.concat(F.lit("data: "), "event_type")).alias("line")))


def _alias_lists(spark, d):
    w = F.split("p_name", " ")
    p = read(spark, d, "part").select("p_partkey", F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b"))
    return p.select("p_partkey", F.array_join(s.alias_list(F.concat(F.lit("["), "a", F.lit(', "'), F.upper("a"), F.lit("\", , '"), "b", F.lit("']"))), "|").alias("names"))


def _name_checks(spark, d):
    own = F.coalesce(F.get(F.split("html", r"[^\p{L}]+"), (F.col("page_id") % 37).cast("int")), F.lit(""))  # every other page gives a word of its own
    w = F.when(F.col("page_id") % 2 == 0, own).otherwise(F.element_at(F.array(*[F.lit(x) for x in CHECKED]), (F.col("page_id") % len(CHECKED) + 1).cast("int")))
    e = F.element_at(F.array(*[F.lit(x) for x in EVIDENCE]), (F.col("page_id") % len(EVIDENCE) + 1).cast("int"))
    p = read(spark, d, "pages").select("page_id", w.alias("w"), e.alias("e"))
    return p.select("page_id", s.fuse_alias_ok(F.col("w"), F.col("e")).alias("fuse"), s.rule_alias_ok(F.col("w"), F.col("e")).alias("rule"), s.span_ok(F.col("w")).alias("span"),
                    s.category(F.col("w")).alias("category"), s.candidate_type(F.col("w"), F.when(F.col("page_id") % 2 == 0, "algorithm").otherwise("other")).alias("kind"))


#: Names that each check takes or refuses for a reason of its own, with evidence.
CHECKED = ["数组名", "int", "a", "x;y", "12_3", "main", "abc", "abcdef", "快速排序算法", "指针操作", "memory/other", "循环", "SortingName", "程序", "排序", "文件操作", " 函数 ", "file读写"]
EVIDENCE = ["", "plain words", "printf(\"x\")", "for (i", "while("]


QUERIES = {
    "page_text": lambda spark, d: text.join_pages(read(spark, d, "pages").select(F.floor(F.col("page_id") / 40).alias("job_id"), F.col("page_id").alias("page"), F.when(F.col("page_id") % 4 == 0, " \n").otherwise(F.col("html")).alias("text"))),
    "duplicate_names": _duplicates,
    "canonical_names": _canonical,
    "review_search": _reviews,
    "fallback_names": lambda spark, d: dedup.fallback_names(_lines(spark, d).where("length(line) between 2 and 400 and line like '%e%'")),
    "merge_fused": _fused_edges,
    "upsert_other": _entities,
    "load_relations": _loaded,
    "sse_data": _events_stream,
    "alias_lists": _alias_lists,
    "name_checks": _name_checks,
    "payload_coerce": lambda spark, d: _parts(imports.coerce(_payloads(spark, d))),
    "rule_fallback": lambda spark, d: _parts(imports.fallback(_subject_texts(spark, d))),
    "import_filter": lambda spark, d: imports.importable(_candidate_json(spark, d)).select("event_id"),
    "pending_sections": lambda spark, d: imports.pending(_sections(spark, d), _found(spark, d)).select("_section_key"),
    "run_summary": lambda spark, d: imports.run_summary(_sections(spark, d), _found(spark, d)),
    "apply_nodes": _apply_nodes,
    "apply_edges": lambda spark, d: _applied(spark, d)[2],
    "apply_replace": lambda spark, d: _applied(spark, d, "replace")[2],
    "kp_edits": _edits,
    "confirm_import": _confirmed,
    "merge_labelled": _labelled,
    "chapter_panels": lambda spark, d: g.chapter_panels(v.graph(spark, d), NODE),
    "fused_links": lambda spark, d: fuse.linked(_triples(spark, d)).select("subject_id", "predicate", "object_id", "ord"),
    "job_transitions": lambda spark, d: review.transitions(read(spark, d, "events").select((F.col("user_id") % 200).alias("job_id"), F.col("event_id").alias("seq"), "event_type").withColumn(
        "status", F.element_at(F.array(*[F.lit(x) for x in review.NEXT]), (F.col("seq") % 6 + 1).cast("int"))).drop("event_type")),
    "code_syntax": _programs,
    "chat_prompts": _prompts,
    "code_parts": _code_parts,
}

_STATES = "[" + ", ".join(f"'{x}'" for x in review.NEXT) + "]"
_APPLY = v.SQL + """,
e AS (SELECT event_id AS seq, user_id % 300 AS u, CASE WHEN event_id % 7 = 0 THEN 'chapter' WHEN event_id % 7 < 4 THEN 'relation' ELSE 'kp' END AS kind FROM events),
i AS (SELECT *, CASE WHEN kind = 'relation' THEN 'add' WHEN seq % 5 = 0 THEN 'delete' WHEN seq % 3 = 0 THEN 'update' ELSE 'add' END AS action, 'KP' || lpad(u::VARCHAR, greatest(6, length(u::VARCHAR))::INTEGER, '0') AS kp, 'CH' || lpad((u % 28)::VARCHAR, greatest(2, length((u % 28)::VARCHAR))::INTEGER, '0') AS chapter FROM e),
ok AS (SELECT * FROM i WHERE NOT (kind = 'kp' AND action = 'add' AND seq % 6 = 1)),
nodes AS (SELECT chapter_id AS key, -1 AS seq, 'add' AS action FROM chapters{base} UNION ALL SELECT kp_id, -1, 'add' FROM kps{base}
 UNION ALL SELECT chapter, seq, CASE WHEN action = 'update' THEN 'add' ELSE action END FROM ok WHERE kind = 'chapter' UNION ALL SELECT kp, seq, action FROM ok WHERE kind = 'kp'),
gone AS (SELECT key, coalesce(max(seq) FILTER (action = 'delete'), -2) AS gone FROM nodes GROUP BY key),
alive AS (SELECT n.key, min(n.seq) AS since FROM nodes n JOIN gone USING (key) WHERE action = 'add' AND seq > gone GROUP BY n.key)"""
_APPLY_EDGES = """,
others AS (SELECT example_id AS key, -1 AS since FROM examples),
every AS (SELECT * FROM alive UNION ALL SELECT * FROM others),
adds AS (SELECT -1 AS seq, src, dst, type, 'base' AS description, 0 AS n FROM edges
 UNION ALL SELECT seq, chapter, kp, 'CONTAINS', NULL, -1 FROM ok WHERE kind = 'kp' AND action = 'add'
 UNION ALL SELECT seq, kp, 'KP' || lpad((seq % 290)::VARCHAR, greatest(6, length((seq % 290)::VARCHAR))::INTEGER, '0'), CASE WHEN seq % 2 = 0 THEN 'EXTENDS' ELSE 'RELATED' END, 'v' || seq, 1 FROM ok WHERE kind = 'relation'),
live AS (SELECT a.* FROM adds a JOIN every s ON s.key = a.src JOIN every t ON t.key = a.dst WHERE a.seq >= s.since AND a.seq >= t.since)
SELECT src, dst, type, arg_max(coalesce(description, ''), n * 1000000000 + seq) AS d, max(n) AS n FROM live GROUP BY src, dst, type"""


def _edges_sql(base: str) -> str:
    return "WITH " + _APPLY.replace("{base}", base) + ", told AS (" + _APPLY_EDGES.strip().removeprefix(",").replace("others AS", "WITH others AS", 1) + ") SELECT src, dst, type, CASE WHEN n = -1 THEN NULL ELSE d END AS description FROM told"


_LINES = "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"
_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '" + w.replace("'", "''") + "')" for w in words) + ")"
_CATEGORY = "CASE " + " ".join(f"WHEN t = '{k}' THEN '{x}'" for k, x in tables.CATEGORIES.items()) + " " + " ".join(f"WHEN {_ANY('lower(t)', words)} THEN '{x}'" for words, x in tables.CATEGORY_RULES) + " ELSE 'other' END"
SQL = {
    "page_text": """SELECT job_id, string_agg(text, chr(10) ORDER BY page) AS text FROM (SELECT page_id // 40 AS job_id, page_id AS page, CASE WHEN page_id % 4 = 0 THEN ' ' || chr(10) ELSE html END AS text FROM pages)
WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY job_id""",
    "duplicate_names": """WITH names AS (SELECT n_name || ' ' || (c_custkey % 3) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_name FROM customer),
k AS (SELECT n_nationkey AS ordinal, replace(lower(n_name), ' ', '') AS b FROM nation), n AS (SELECT name, replace(lower(name), ' ', '') AS a FROM names)
SELECT name, min_by(ordinal, ordinal)::VARCHAR AS duplicate_of FROM n LEFT JOIN k ON contains(a, b) OR contains(b, a) GROUP BY name""",
    "canonical_names": """WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '  ') ELSE p_name || '?' END AS name FROM part),
k AS (SELECT replace(lower(p_name), ' ', '') AS key, arg_min(p_name, p_partkey) AS near FROM part GROUP BY 1)
SELECT n.name, n.p_partkey, coalesce(CASE WHEN n.name IN (SELECT p_name FROM part) THEN n.name END, k.near, n.name) AS canonical FROM n LEFT JOIN k ON k.key = replace(lower(n.name), ' ', '')""",
    "review_search": """WITH e AS (SELECT 'REV' || event_id AS id, CASE WHEN event_id % 2 = 1 THEN 'approved' ELSE 'pending' END AS status, event_type AS name FROM events)
SELECT * FROM e WHERE status = 'approved' AND (contains(id, '99') OR contains(name, '99')) UNION ALL SELECT * FROM e WHERE contains(id, 'purchase') OR contains(name, 'purchase')""",
    "fallback_names": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS i FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE length(line) BETWEEN 2 AND 400 AND line LIKE '%e%'), b AS (SELECT doc_id, line, min(i) AS i FROM a WHERE r <= 30 GROUP BY doc_id, line)
SELECT doc_id, seq::INTEGER AS seq, line AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq FROM b) WHERE seq <= 24""",
    "merge_fused": f"""WITH {TRIPLES} SELECT src, dst, predicate, source, CASE WHEN n > 0 THEN x.s ELSE 'before' END AS section_key, CASE WHEN n > 0 THEN x.e END AS evidence FROM (SELECT subject_id AS src, object_id AS dst, predicate, source,
 count(*) FILTER (ord % 3 <> 0) AS n, arg_max(struct_pack(s := section_key, e := evidence), ord) FILTER (ord % 3 <> 0) AS x FROM t WHERE object_id IS NOT NULL GROUP BY subject_id, object_id, predicate, source)""",
    "upsert_other": """WITH r AS (SELECT 'E' || (s_suppkey % 40) AS id, arg_max(s_name, s_suppkey) AS name FROM supplier WHERE s_suppkey % 3 = 2 GROUP BY 1)
SELECT coalesce('E' || n_nationkey, id) AS entity_id, coalesce(name, n_name) AS name, CASE WHEN id IS NULL THEN 'old' END AS note FROM nation FULL JOIN r ON id = 'E' || n_nationkey""",
    "load_relations": "WITH " + v.SQL + """ SELECT CASE WHEN src IN (SELECT kp_id FROM kps) AND dst IN (SELECT kp_id FROM kps WHERE source_page > 10) THEN 'linked' ELSE 'lost' END AS kind, src, dst, type FROM edges WHERE type IN ('CONTAINS', 'RELATED')""",
    "sse_data": "SELECT event_id AS i, event_type AS data FROM events WHERE event_id % 5 <> 1 AND event_id < 900",
    "alias_lists": "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) END AS names FROM part",
    "name_checks": f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN coalesce(regexp_split_to_array(html, '[^\\p{{L}}]+')[page_id % 37 + 1], '') ELSE [{", ".join(f"'{x}'" for x in CHECKED)}][page_id % {len(CHECKED)} + 1] END AS w, [{", ".join(f"'{x}'" for x in EVIDENCE)}][page_id % {len(EVIDENCE)} + 1] AS e FROM pages), q AS (SELECT *, trim(w) AS t FROM p)
SELECT page_id, length(t) BETWEEN 2 AND 30 AND lower(t) NOT IN {_IN(tables.FUSE_ALIAS_TOKENS)} AND NOT regexp_matches(t, '^[0-9_\\s[:punct:]]+$') AND NOT {_ANY('e', tables.FUSE_EVIDENCE)} AND NOT regexp_matches(t, '[(){{}};,]') AS fuse,
 length(t) BETWEEN 2 AND 20 AND lower(t) NOT IN {_IN(tables.RULE_ALIAS_BLOCK)} AND NOT regexp_matches(t, '^[0-9_\\s[:punct:]]+$') AND NOT regexp_matches(t, '[{{}};,]') AND NOT {_ANY('e', tables.RULE_EVIDENCE)} AND NOT (regexp_matches(t, '^[a-z_\\-]+$') AND length(t) <= 5) AS rule,
 length(t) BETWEEN 2 AND 20 AND NOT regexp_matches(t, '[(){{}}\\[\\];,:#%*/]') AND t NOT IN {_IN(tables.SPAN_NOISE)} AS span, {_CATEGORY} AS category,
 CASE WHEN regexp_matches(w, '^(?:{"|".join(tables.METHOD_NAMES)})') OR (page_id % 2 = 0 AND NOT {_ANY('w', tables.CONCEPT_WORDS)}) THEN 'MethodPattern' ELSE 'KnowledgePoint' END AS kind FROM q""",
    "payload_coerce": """WITH s AS (SELECT s_nationkey AS nk, list(s_name ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1),
n AS (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey AS nk, CASE WHEN n_nationkey % 5 <> 2 THEN n_name END AS name, coalesce(names, []) AS names FROM nation LEFT JOIN s ON s.nk = n_nationkey WHERE n_regionkey < 3),
c AS (SELECT doc_id, nk, 0 AS part, CASE WHEN nk % 3 = 0 THEN coalesce(name, 'root') ELSE coalesce(name, 'root') END AS title, names FROM n UNION ALL SELECT doc_id, nk, 1, 'extra', ['last'] FROM n WHERE nk % 3 = 0),
o AS (SELECT doc_id, title, names, row_number() OVER (PARTITION BY doc_id ORDER BY nk, part) AS seq FROM c),
x AS (SELECT doc_id, seq, title, unnest(names) AS name, unnest(range(len(names))) AS i FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, i) AS r, lead(seq) OVER (PARTITION BY doc_id ORDER BY seq, i) AS after FROM x)
SELECT doc_id, 'chapter' AS kind, 'CH' || lpad(seq::VARCHAR, greatest(2, length(seq::VARCHAR))::INTEGER, '0') AS a, title AS b, seq::VARCHAR AS c FROM o
UNION ALL SELECT doc_id, 'kp', 'KP' || lpad(r::VARCHAR, greatest(4, length(r::VARCHAR))::INTEGER, '0'), name, 'CH' || lpad(seq::VARCHAR, greatest(2, length(seq::VARCHAR))::INTEGER, '0') FROM k
UNION ALL SELECT doc_id, 'relation', 'KP' || lpad(r::VARCHAR, greatest(4, length(r::VARCHAR))::INTEGER, '0'), 'KP' || lpad((r + 1)::VARCHAR, 4, '0'), '同章节知识点关联: ' || title FROM k WHERE after = seq
UNION ALL SELECT n_regionkey, 'kp', 'K1', 'own', 'C1' FROM (SELECT DISTINCT n_regionkey FROM nation) WHERE n_regionkey >= 3 UNION ALL SELECT n_regionkey, 'relation', 'K1', 'K2', 'own' FROM (SELECT DISTINCT n_regionkey FROM nation) WHERE n_regionkey >= 3
UNION ALL SELECT 3, 'chapter', NULL, CASE WHEN nk % 3 <> 0 THEN NULL END, NULL FROM (SELECT n_nationkey AS nk FROM nation WHERE n_regionkey = 3)""",
    "rule_fallback": f"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '第 ' || (doc_id % 9 + 1) || ' 章 开头' || chr(10) || '变量 ' || (doc_id % 7) || chr(10) || '第二章 后面' || chr(10) || ' 数组与指针 ' || chr(10) || '变量 ' || (doc_id % 7) || chr(10) || '函数' || chr(10)
 WHEN 1 THEN '文件' || chr(10) ELSE '' END || text AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, {_LINES} AS l FROM d),
s AS (SELECT doc_id, list_slice(list_transform(list_filter(l, lambda x: regexp_matches(x, '{imports.CHAPTER_LINE}')), lambda x: substr(x, 1, 40)), 1, 6) AS t, list_slice(list_filter(l, lambda x: length(x) BETWEEN 2 AND 40 AND regexp_matches(x, '{"|".join(imports.SUBJECT_WORDS)}')), 1, 30) AS n FROM l),
u AS (SELECT doc_id, CASE WHEN len(t) > 0 THEN t ELSE ['{imports.DEFAULT_CHAPTERS[0]}'] END AS t, list_slice(list_filter(list_transform(range(len(n)), lambda i: CASE WHEN list_position(n, n[i + 1]) = i + 1 THEN n[i + 1] END), lambda x: x IS NOT NULL), 1, 24) AS n FROM s),
w AS (SELECT doc_id, t, CASE WHEN len(n) > 0 THEN n ELSE [{", ".join(f"'{x}'" for x in imports.DEFAULT_SUBJECTS)}] END AS n FROM u)
SELECT doc_id, 'chapter' AS kind, 'CH' || lpad(i::VARCHAR, greatest(2, length(i::VARCHAR))::INTEGER, '0') AS a, t[i] AS b, i::VARCHAR AS c FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM w)
UNION ALL SELECT doc_id, 'kp', 'KP' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0'), n[i], 'CH' || lpad(((i - 1) % len(t) + 1)::VARCHAR, 2, '0') FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM w)
UNION ALL SELECT doc_id, 'relation', 'KP' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0'), 'KP' || lpad((i + 1)::VARCHAR, 4, '0'), '基于文本规则抽取的相邻知识点关系' FROM (SELECT *, unnest(range(1, len(n))) AS i FROM w)""",
    "import_filter": "SELECT event_id FROM events WHERE event_id % 4 IN (0, 3) AND event_id % 3 <> 2",
    "pending_sections": "SELECT doc_id AS _section_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "run_summary": """SELECT count(*) AS sections, coalesce(sum(n), 0)::BIGINT AS total_new, coalesce(sum(dup), 0)::BIGINT AS total_dup, count(*) FILTER (n IS NULL OR length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 80) AS total_empty
FROM documents LEFT JOIN (SELECT doc_id, count(*) FILTER (toxic <> 1) AS n, count(*) FILTER (toxic = 1) AS dup FROM labels GROUP BY doc_id) USING (doc_id)""",
    "apply_nodes": "WITH " + _APPLY.replace("{base}", "") + """,
cv AS (SELECT chapter_id AS key, -1 AS seq, title, "order" FROM chapters UNION ALL SELECT chapter, seq, 'v' || seq, seq FROM ok WHERE kind = 'chapter' AND action <> 'delete'),
cl AS (SELECT c.*, row_number() OVER (PARTITION BY c.key ORDER BY c.seq DESC) AS r FROM cv c JOIN alive a ON a.key = c.key AND c.seq >= a.since),
kv AS (SELECT kp_id AS key, -1 AS seq, 'add' AS action, name, chapter_id, section, aliases, source FROM kps UNION ALL SELECT kp, seq, action, 'v' || seq, chapter, CASE WHEN seq % 4 = 0 THEN 'v' || seq END, 'a', CASE WHEN seq % 6 <> 1 THEN 'v' || seq END FROM ok WHERE kind = 'kp' AND action <> 'delete'),
kl AS (SELECT k.* FROM kv k JOIN alive a ON a.key = k.key AND k.seq >= a.since),
ks AS (SELECT key, arg_max(name, seq) AS name, arg_max(chapter_id, seq) AS chapter_id, arg_max(coalesce(section, '-'), seq) FILTER (action = 'add' OR section IS NOT NULL) AS section, arg_max(aliases, seq) AS aliases, arg_max(source, seq) FILTER (action = 'add' OR source IS NOT NULL) AS source FROM kl GROUP BY key)
SELECT 'chapter' AS kind, key AS id, title AS a, "order"::VARCHAR AS b FROM cl WHERE r = 1 UNION ALL SELECT 'kp', key, name, concat_ws('|', chapter_id, section, aliases, source) FROM ks
UNION ALL SELECT 'failed', 'REV' || seq, 'missing source', NULL FROM i WHERE kind = 'kp' AND action = 'add' AND seq % 6 = 1""",
    "apply_edges": _edges_sql(""),
    "apply_replace": _edges_sql(" WHERE false"),
    "kp_edits": """SELECT event_id AS ord, ['add', 'update', 'delete'][event_id % 3 + 1] AS action, ['手动新增', '手动编辑', '手动删除'][event_id % 3 + 1] AS source,
 'kp_id=KP' || lpad(user_id::VARCHAR, greatest(6, length(user_id::VARCHAR))::INTEGER, '0') || CASE WHEN event_id % 3 = 2 THEN '' ELSE ';name=' || event_type || CASE WHEN event_id % 4 = 0 THEN ';section=s' WHEN event_id % 3 = 0 THEN ';section' ELSE '' END END AS data FROM events""",
    "confirm_import": """WITH q AS (SELECT 0 AS part, p_partkey AS k, 'kp' AS type, CASE WHEN p_partkey % 3 = 0 THEN 'update' ELSE 'add' END AS action FROM part UNION ALL SELECT 1, s_suppkey, 'relation', 'add' FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY part, k) AS n FROM q)
SELECT 'REV' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS id, type, action, 'pending' AS status, 'KP' || lpad(k::VARCHAR, greatest(6, length(k::VARCHAR))::INTEGER, '0') AS node FROM r""",
    "merge_labelled": "WITH " + v.SQL + """, r AS (SELECT 'KP' || lpad(o_custkey::VARCHAR, greatest(6, length(o_custkey::VARCHAR))::INTEGER, '0') AS kp_id, 'o' || max(o_orderkey) AS name FROM orders GROUP BY 1)
SELECT 'node' AS kind, coalesce(k.kp_id, r.kp_id) AS kp_id, CASE WHEN r.kp_id IS NOT NULL AND (k.kp_id IS NULL OR k.source_page % 2 = 0) THEN r.name ELSE k.name END AS name, CASE WHEN k.source_page % 2 = 0 OR k.kp_id IS NULL THEN 'KnowledgePoint,Entity' ELSE 'KnowledgePoint' END AS labels FROM kps k FULL JOIN r ON k.kp_id = r.kp_id
UNION ALL SELECT 'violation', kp_id, NULL, NULL FROM r JOIN kps k USING (kp_id) WHERE k.source_page % 2 <> 0""",
    "chapter_panels": "WITH " + v.SQL + f""", p AS (SELECT 'prerequisites' AS panel, src AS far FROM dag WHERE dst = '{NODE}' UNION ALL SELECT 'successors', dst FROM dag WHERE src = '{NODE}' UNION ALL
 (SELECT 'related', kp_id FROM (SELECT dst AS far FROM edges WHERE type = 'RELATED' AND src = '{NODE}' UNION ALL SELECT src FROM edges WHERE type = 'RELATED' AND dst = '{NODE}' AND src <> '{NODE}') JOIN kps ON kp_id = far ORDER BY kp_id LIMIT {g.RELATED_LIMIT}))
SELECT panel, kp_id, name FROM p JOIN kps ON kp_id = far WHERE chapter_id = (SELECT chapter_id FROM kps WHERE kp_id = '{NODE}')""",
    "fused_links": f"WITH {TRIPLES} SELECT subject_id, predicate, object_id, ord FROM t WHERE subject_id <> '' AND object_id <> ''",
    "job_transitions": f"""WITH e AS (SELECT user_id % 200 AS job_id, event_id AS seq, {_STATES}[event_id % 6 + 1] AS status FROM events), x AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM e)
SELECT job_id, seq, status, before FROM x WHERE before IS NOT NULL AND before || '>' || status NOT IN ({", ".join(f"'{a}>{b}'" for a, bs in review.NEXT.items() for b in bs)})""",
    "code_syntax": "SELECT page_id, [" + ", ".join("'" + ",".join(p) + "'" for _, p in PROGRAMS) + f"][page_id % {len(PROGRAMS)} + 1] AS patterns FROM pages",
    "chat_prompts": "SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '相关知识点: ' || role || ', x' ELSE '' END || CASE WHEN turn % 3 = 0 THEN chr(10) || '当前章节: CH01' ELSE '' END AS prompt FROM conversations",
    "code_parts": "SELECT conv_id, turn, 0 AS i, 'c' AS lang, 'int x;' || chr(10) AS code FROM conversations UNION ALL SELECT conv_id, turn, 1, role, '' FROM conversations",
}
