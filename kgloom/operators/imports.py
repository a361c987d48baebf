"""Model answers and texts into graph rows, and these into a graph. What is within one document is array expressions in its row, without a
shuffle; imports join by name and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import py_strip
from ..plans.staging import cut

#: What a text without chapters or subjects gets, and the words that make a line a subject.
DEFAULT_CHAPTERS = ["C语言基础知识"]
DEFAULT_SUBJECTS = ["变量与数据类型", "分支与循环", "函数与数组", "指针与字符串"]
SUBJECT_WORDS = ["变量", "数据类型", "常量", "运算符", "表达式", "分支", "循环", "函数", "数组", "指针", "结构体", "文件", "预处理", "编译", "调试", "递归", "字符串", "内存", "算法", "流程图"]
CHAPTER_LINE = r"第\s*[一二三四五六七八九十0-9]+\s*章"
CHAPTERS, TITLE, LINES, SUBJECTS = 6, 40, 30, 24

PAYLOAD = ("chapter string, chapters array<struct<chapter_id string, title string, `order` bigint, chapter string, chapter_key string, keypoints array<string>, "
           "chapters array<struct<chapter_key string, title string, keypoints array<string>>>>>, "
           "kps array<struct<kp_id string, name string, chapter_id string, section string, aliases string, source string>>, "
           "relations array<struct<source string, target string, relation_type string, description string>>")


def numbered(prefix: str, n: Column, width: int) -> Column:
    """An id as %0{width}d writes it: longer numbers aren't cut."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), F.greatest(F.lit(width), F.length(n.cast("string"))), F.lit("0")))


def _text(c: Column) -> Column:
    return F.nullif(py_strip(F.coalesce(c, F.lit(""))), F.lit(""))


def _graph(docs: DataFrame, chapters: Column, source: str, note) -> DataFrame:
    """docs with `chapters`, `kps` and `relations` arrays. chapters: an array of (title or null, names); note(title) describes the
    relation of neighbours in a chapter."""
    s = docs.withColumn("_c", F.transform(chapters, lambda c, i: F.struct(
        numbered("CH", i + 1, 2).alias("chapter_id"), F.coalesce(c["title"], F.concat(F.lit("章节"), (i + 1).cast("string"))).alias("title"), (i + 1).cast("bigint").alias("order"), c["names"].alias("names"))))
    every = F.flatten(F.transform("_c", lambda c: F.transform(c["names"], lambda n: F.struct(n.alias("name"), c["chapter_id"].alias("chapter_id"), c["title"].alias("title")))))
    s = s.withColumn("_k", F.transform(every, lambda k, i: F.struct(numbered("KP", i + 1, 4).alias("kp_id"), k["name"].alias("name"), k["chapter_id"].alias("chapter_id"), F.lit(source).alias("source"), k["title"].alias("title"))))
    pairs = F.filter(F.arrays_zip("_k", F.slice("_k", F.lit(2), F.greatest(F.size("_k"), F.lit(0))).alias("after")), lambda p: p["after"]["chapter_id"] == p["_k"]["chapter_id"])
    return s.select("*", F.transform("_c", lambda c: c.dropFields("names")).alias("chapters"), F.transform("_k", lambda k: k.dropFields("title")).alias("kps"),
                    F.transform(pairs, lambda p: F.struct(p["_k"]["kp_id"].alias("source"), p["after"]["kp_id"].alias("target"), F.lit("RELATED").alias("relation_type"), note(p["_k"]["title"]).alias("description"))).alias("relations")).drop("_c", "_k")


def coerce(answers: DataFrame) -> DataFrame:
    """answers (doc_id, payload as PAYLOAD) with arrays `chapters`, `kps`, `relations` in one form. A payload with kps or relations
    passes; else chapters, or the chapters within them, list names, which get ids in order and an edge to the next one.
    A name that isn't text counts as its text. A null payload gives nothing."""
    p = F.col("payload")
    names = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), py_strip), lambda n: n != "")
    one = lambda title, keys: F.struct(title.alias("title"), names(keys).alias("names"))
    nested = lambda c: (F.coalesce(F.size(c["chapters"]), F.lit(0)) > 0) & (F.coalesce(F.size(c["keypoints"]), F.lit(0)) <= 0)
    parts = _parts(p, one, nested)
    made = _graph(answers, parts, "pdf_ai", lambda title: F.concat(F.lit("同章节知识点关联: "), title))
    ready = (F.coalesce(F.size(p["kps"]), F.lit(0)) > 0) | (F.coalesce(F.size(p["relations"]), F.lit(0)) > 0)
    own_chapters = F.transform(F.coalesce(p["chapters"], F.array().cast(_type("chapters"))), lambda c: F.struct(c["chapter_id"].alias("chapter_id"), c["title"].alias("title"), c["order"].alias("order")))
    own_kps = F.transform(F.coalesce(p["kps"], F.array().cast(_type("kps"))), lambda k: F.struct(*[k[x].alias(x) for x in ("kp_id", "name", "chapter_id", "source")]))
    own_relations = F.coalesce(p["relations"], F.array().cast(_type("relations")))
    return made.select("doc_id", F.when(ready, own_chapters).otherwise(F.col("chapters")).alias("chapters"), F.when(ready, own_kps).otherwise(F.col("kps")).alias("kps"),
                       F.when(ready, own_relations).otherwise(F.col("relations")).alias("relations"))


def _type(field: str) -> str:
    from pyspark.sql import types as T

    return T._parse_datatype_string(PAYLOAD)[field].dataType.simpleString()


def _parts(p: Column, one, nested) -> Column:
    """The (title, names) of a payload's chapters, those within a chapter in its place."""
    def parts(c):
        inner = F.transform(c["chapters"], lambda x: one(F.coalesce(_text(x["chapter_key"]), _text(x["title"]), _text(c["chapter"]), _text(p["chapter"])), x["keypoints"]))
        return F.when(nested(c), inner).otherwise(F.array(one(F.coalesce(_text(c["chapter_key"]), _text(c["title"]), _text(p["chapter"])), c["keypoints"])))

    return F.flatten(F.transform(F.coalesce(p["chapters"], F.array().cast(_type("chapters"))), parts))


def fallback(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with arrays `chapters`, `kps`, `relations` by rules: the first chapter lines, and the first lines that name
    a subject, dealt to the chapters in turn, each with an edge to the next. Null text counts as empty and gets the defaults."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), py_strip), lambda x: x != "")
    s = docs.select("doc_id", lines.alias("_l"))
    titles = F.slice(F.transform(F.filter("_l", lambda x: F.regexp_like(x, F.lit(CHAPTER_LINE))), lambda x: F.substring(x, 1, TITLE)), 1, CHAPTERS)
    names = F.slice(F.array_distinct(F.slice(F.filter("_l", lambda x: F.length(x).between(2, 40) & F.regexp_like(x, F.lit("|".join(SUBJECT_WORDS)))), 1, LINES)), 1, SUBJECTS)
    default = lambda c, words: F.when(F.size(c) > 0, c).otherwise(F.array(*[F.lit(w) for w in words]))
    s = s.select("doc_id", default(titles, DEFAULT_CHAPTERS).alias("_t"), default(names, DEFAULT_SUBJECTS).alias("_n"))
    kps = F.transform("_n", lambda n, i: F.struct(numbered("KP", i + 1, 4).alias("kp_id"), n.alias("name"), numbered("CH", F.pmod(i, F.size("_t")) + 1, 2).alias("chapter_id"), F.lit("pdf_fallback").alias("source")))
    chapters = F.transform("_t", lambda x, i: F.struct(numbered("CH", i + 1, 2).alias("chapter_id"), x.alias("title"), (i + 1).cast("bigint").alias("order")))
    edge = lambda i: F.struct(numbered("KP", i, 4).alias("source"), numbered("KP", i + 1, 4).alias("target"), F.lit("RELATED").alias("relation_type"), F.lit("基于文本规则抽取的相邻知识点关系").alias("description"))
    relations = F.when(F.size("_n") > 1, F.transform(F.sequence(F.lit(1), F.size("_n") - 1), edge)).otherwise(F.array().cast(_type("relations")))
    return s.select("doc_id", chapters.alias("chapters"), kps.alias("kps"), relations.alias("relations"))


def importable(rows: DataFrame, column: str = "json") -> DataFrame:
    """Rows of JSON objects that are no duplicates and whose type is, or by default is, a knowledge point. The default is for a
    missing key; an explicit null is no type and goes."""
    json = F.col(column)
    known = F.array_contains(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), "candidate_type")
    kind = F.when(known, F.get_json_object(json, "$.candidate_type")).otherwise("KnowledgePoint")
    return rows.where((F.coalesce(F.get_json_object(json, "$.duplicate_of"), F.lit("")) == "") & F.coalesce(kind == "KnowledgePoint", F.lit(False)))


def pending(sections: DataFrame, done: DataFrame, key: str = "_section_key") -> DataFrame:
    """Sections that no earlier run gave a row for; those that gave nothing are tried again."""
    return sections.join(done.select(key).distinct(), key, "left_anti").select(*sections.columns)


def run_summary(sections: DataFrame, found: DataFrame, least: int = 80) -> DataFrame:
    """One row of counts of a run: new and duplicate rows, and sections that were too short or gave nothing.
    sections: _section_key, text; found: _section_key, duplicate_of."""
    per = found.groupBy("_section_key").agg(F.count_if(F.coalesce("duplicate_of", F.lit("")) == "").alias("new"), F.count_if(F.coalesce("duplicate_of", F.lit("")) != "").alias("dup"))
    s = sections.select("_section_key", (F.length(py_strip(F.coalesce("text", F.lit("")))) < least).alias("short")).join(per, "_section_key", "left")
    return s.agg(F.count(F.lit(1)).alias("sections"), F.coalesce(F.sum("new"), F.lit(0)).alias("total_new"), F.coalesce(F.sum("dup"), F.lit(0)).alias("total_dup"), F.count_if(F.col("short") | F.col("new").isNull()).alias("total_empty"))


#: What an imported row writes, the first number behind which ids begin, and where nodes are from.
IMPORTED, ID_START, IMPORT_SOURCE = ["name", "chapter_id", "section", "aliases", "category", "summary", "description", "code_example"], 9000, "ai_extracted"


def import_extracted(nodes: DataFrame, edges: DataFrame, chapters: DataFrame, found: DataFrame, start: int = ID_START) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report) after rows that importable() let pass are merged: numbered in their order (ord), contained in their chapter where that is there,
    tied to the nodes that their lists name. A name is looked up among the new rows first, the last of equal names, then among
    the nodes, that of the largest id; names that neither has are counted. An edge that is there stays as it is.

    nodes: kp_id, IMPORTED, source, reviewed; edges: src, dst, type, ...; chapters: chapter_id; found: ord, IMPORTED, prerequisites, related.
    """
    from ..functions.scalars import norm_fuse
    from .dedup import sequence_ids
    from .resolve import prioritized
    from .store import merge_nodes

    filled = [F.coalesce(F.col(c), F.lit("other" if c == "category" else "")).alias(c) for c in IMPORTED]
    new = cut(sequence_ids(found, "KP", 4, ["ord"], start + 1).select("ord", F.col("seq_id").alias("kp_id"), *filled, "prerequisites", "related"))
    key = norm_fuse(F.col("name"))
    fresh = new.where(key != "").groupBy(key.alias("key")).agg(F.max_by("kp_id", "ord").alias("value"))
    old = nodes.where(F.col("name") != "").groupBy(key.alias("key")).agg(F.max("kp_id").alias("value"))
    named = lambda kind, column: new.select(F.col("kp_id").alias("of"), F.lit(kind).alias("type"), F.explode(column).alias("name"))
    links = cut(prioritized(named("PREREQUISITE", "prerequisites").unionAll(named("RELATED", "related")), fresh, old, norm_fuse))
    ahead = F.col("type") == "PREREQUISITE"
    tied = links.where("kp_id is not null").select(F.when(ahead, F.col("kp_id")).otherwise(F.col("of")).alias("src"), F.when(ahead, F.col("of")).otherwise(F.col("kp_id")).alias("dst"), "type")
    contained = new.join(chapters.select("chapter_id").distinct(), "chapter_id").select(F.col("chapter_id").alias("src"), F.col("kp_id").alias("dst"), F.lit("CONTAINS").alias("type"))
    added = contained.unionAll(tied).distinct().join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    rows = new.select("kp_id", *IMPORTED, F.lit(IMPORT_SOURCE).alias("source"), F.lit(False).alias("reviewed"), "ord")
    count = lambda kind, hit: F.count_if((F.col("type") == kind) & (F.col("kp_id").isNotNull() == hit))
    report = links.agg(count("PREREQUISITE", True).alias("prerequisites"), count("PREREQUISITE", False).alias("missed_prerequisites"), count("RELATED", True).alias("related"), count("RELATED", False).alias("missed_related"))
    report = report.withColumn("imported", new.agg(F.count(F.lit(1))).scalar())
    return merge_nodes(nodes, rows, "kp_id", [*IMPORTED, "source", "reviewed"]), edges.unionByName(added, allowMissingColumns=True), report


def to_review(job: str, chapters: DataFrame, kps: DataFrame, relations: DataFrame, existing: DataFrame) -> DataFrame:
    """Review items (ord, type, action, data, source) of what a job extracted, chapters first, then nodes, updates where their id is there, then relations.
    Each part has ord and data, a map; an extraction without any row is an error."""
    if chapters.isEmpty() and kps.isEmpty() and relations.isEmpty():
        raise ValueError("nothing was extracted: no items for review")
    known = existing.select(F.col("kp_id").alias("_id"), F.lit("update").alias("_there")).distinct()
    k = kps.withColumn("_id", F.coalesce(F.element_at("data", "kp_id"), F.lit(""))).join(known, "_id", "left")
    part = lambda i, kind, df, action: df.select(F.struct(F.lit(i).alias("part"), F.col("ord").alias("ord")).alias("ord"), F.lit(kind).alias("type"), action.alias("action"), "data")
    add = F.lit("add")
    out = part(0, "chapter", chapters, add).unionAll(part(1, "kp", k, F.coalesce("_there", add))).unionAll(part(2, "relation", relations, add))
    return out.withColumn("source", F.lit(f"PDF抽取:{job}"))
