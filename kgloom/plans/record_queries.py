"""Triples, entities, sequences, review and job logs over the event-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import dedup, fuse, resolve, review
from ..sources import files
from .graphview import read


def _triples(spark, d):
    e = read(spark, d, "events")
    return e.select((F.col("user_id") % 50).cast("string").alias("subject_id"), "event_type", F.col("event_type").alias("predicate"), F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("O"), (F.col("event_id") % 13).cast("string"))).alias("object_id"),
                    F.when(F.col("event_id") % 2 == 0, "text_rule").otherwise("code_ast").alias("source"), (F.col("event_id") % 4).cast("string").alias("section_key"), F.col("event_id").alias("ord"),
                    F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("evidence")).drop("event_type")


TRIPLES = """t AS (SELECT (user_id % 50)::VARCHAR AS subject_id, event_type AS predicate, CASE WHEN event_id % 9 <> 0 THEN 'O' || (event_id % 13) END AS object_id, CASE WHEN event_id % 2 = 0 THEN 'text_rule' ELSE 'code_ast' END AS source,
 (event_id % 4)::VARCHAR AS section_key, event_id AS ord, 'e' || event_id AS evidence FROM events)"""


def _entities(spark, d):
    c = read(spark, d, "nation").select(F.concat(F.lit("E"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.lit("Chapter").alias("entity_type"), F.col("n_name").alias("entity_name"), F.col("n_nationkey").cast("bigint").alias("ord"))
    k = read(spark, d, "supplier").select(F.concat(F.lit("E"), (F.col("s_suppkey") % 40).cast("string")), F.lit("KnowledgePoint"), "s_name", F.col("s_suppkey")).toDF("entity_id", "entity_type", "entity_name", "ord")
    return dedup.upsert_entities([c, k])


def _turns(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("key"))


def _seq(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn")
    return dedup.sequence_ids(c, "KP", 4, ["conv_id", "turn"], 9001)


def _reviews(spark, d):
    e = read(spark, d, "events")
    return e.select(F.concat(F.lit("REV"), (F.col("user_id") % 300).cast("string")).alias("id"), F.col("event_id").alias("seq"),
                    F.element_at(F.array(*[F.lit(x) for x in ("pending", "approved", "rejected")]), (F.col("event_id") % 3 + 1).cast("int")).alias("status"))


def _fused(spark, d):
    """Rule, code and gold rows made of conversations, fused over a small dictionary."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w")).where("size(w) >= 2")
    ord_ = (F.col("conv_id") * 100 + F.col("turn")).alias("ord")
    name, other = F.lower(F.get("w", F.lit(0))), F.lower(F.get("w", F.lit(1)))
    kinds = F.array(*[F.lit(x) for x in ("MENTIONS_KP", "PREREQUISITE", "ALIAS")])
    text = c.select(F.lit(None).cast("string").alias("subject_id"), name.alias("subject_name"), F.element_at(kinds, (F.col("turn") % 3 + 1).cast("int")).alias("predicate"), F.lit(None).cast("string").alias("object_id"), other.alias("object_name"),
                    F.lit("ev").alias("evidence"), F.lit("text_rule").alias("source"), F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("section_key"), ord_)
    code = c.select(F.concat(F.lit("c "), F.col("conv_id").cast("string")).alias("subject_id"), name.alias("subject_name"), name.alias("mapped_kp"), other.alias("object_name"), F.lit("ev").alias("evidence"), F.lit("code_ast").alias("source"), F.lit("a.c").alias("file_path"), ord_)
    gold = c.select(F.concat(F.lit("G"), F.col("conv_id").cast("string")).alias("sample_id"), F.lit("CH01").alias("chapter_id"), F.lit("1.1").alias("section"), F.lit("t").alias("text_fragment"), F.lit("q").alias("question"),
                    F.array(name).alias("knowledge_points"), F.array(F.struct(F.lit("belongs_to_chapter").alias("type"), F.lit("CH01").alias("target")), F.struct(F.lit("related").alias("type"), other.alias("target"))).alias("relation_hints"), ord_)
    words = c.select(F.explode("w").alias("x")).select(s.norm_fuse(F.col("x")).alias("key")).where("length(key) >= 5").distinct()
    dictionary = words.select("key", F.concat(F.lit("KP_"), "key").alias("value"), F.struct(F.length("key").alias("n"), "key").alias("ordinal"))
    return fuse.fuse(text, code, gold, dictionary)


def _json_rows(spark, d):
    e = read(spark, d, "events").where("props is not null")
    odd = F.concat(F.lit("```json\n"), F.regexp_replace(F.regexp_replace("props", r'"(\w+)":', "$1:"), r"\}$", ", note: 'x y',}"), F.lit(" // end\n```"))
    return e.select("event_id", s.repair_json(odd).alias("fixed"))


def _rollup(spark, d):
    """All documents, over 20 of the 25 chapters; the others have none."""
    ch = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("chapter_id"))
    sec = read(spark, d, "documents").select((F.col("doc_id") % 20).cast("string").alias("chapter_id"), F.col("n_chars").alias("char_count"), (F.col("doc_id") % 3).alias("code_block_count"))
    return dedup.chapter_rollup(ch, sec)


def _priority(spark, d):
    """All parts are links and in both indexes, some of them by a name that differs."""
    p = read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))
    index = lambda n, x: p.groupBy(s.norm_fuse(F.when(F.col("k") % n == 0, F.col("name")).otherwise(F.concat("name", F.lit("!")))).alias("key")).agg(
        F.max(F.concat(F.lit(x), F.col("k").cast("string"))).alias("value"))
    links = p.select(F.when(F.col("k") % 6 == 0, F.upper("name")).when(F.col("k") % 6 == 3, F.concat("name", F.lit("?"))).when(F.col("k") % 6 == 1, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), "k")
    return resolve.prioritized(links, index(5, "N"), index(2, "O"), s.norm_fuse)


def _pages(spark, d):
    p = read(spark, d, "pages").select(F.lit("job").alias("job_id"), F.col("page_id").cast("int").alias("page"), F.col("html").alias("text"))
    return files.page_window(p, 5, 9).unionAll(files.page_window(p))


QUERIES = {
    "triple_dedup_last": lambda spark, d: dedup.dedup_fused(_triples(spark, d)).select("subject_id", "predicate", "object_id", "source", "section_key", "evidence"),
    "rule_dedup": lambda spark, d: dedup.dedup_rules(_triples(spark, d).withColumn("object_name", F.col("source"))).select("subject_id", "predicate", "object_id", "object_name", "section_key", "evidence", "first_ord"),
    "term_dictionary": lambda spark, d: dedup.dictionary(read(spark, d, "part").select(F.lower("p_name").alias("key"), F.col("p_partkey").cast("string").alias("value"), F.col("p_partkey").alias("ord"))),
    "entity_upsert": _entities,
    "fuse_report": lambda spark, d: dedup.counts_by(_triples(spark, d), "predicate", "source"),
    "fused_triples": lambda spark, d: _fused(spark, d)[0],
    "fused_entities": lambda spark, d: _fused(spark, d)[1],
    "fused_csv": lambda spark, d: fuse.csv_rows(_fused(spark, d)[0]),
    "rdf_lines": lambda spark, d: fuse.rdf_lines(_entities(spark, d), _triples(spark, d).where("object_id is not null").select("subject_id", "predicate", "object_id")).select("part", "key", "line").distinct(),
    "slug_ids": lambda spark, d: read(spark, d, "part").select("p_partkey", s.node_id("SEC", F.concat("p_type", F.lit(" / ("), "p_brand", F.lit(")"))).alias("node")),
    "adjacent_edges": lambda spark, d: dedup.adjacent_edges(_turns(spark, d).distinct(), "conv_id", "turn", "key"),
    "seq_ids": _seq,
    "round_robin": lambda spark, d: dedup.round_robin(_seq(spark, d).withColumn("seq", F.col("seq") - 9000), 7).select("conv_id", "turn", "slot"),
    "chapter_rollup": _rollup,
    "priority_lookup": _priority,
    "review_latest": lambda spark, d: review.latest(_reviews(spark, d)),
    "job_state": lambda spark, d: review.job_state(read(spark, d, "events").select((F.col("user_id") % 200).alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "value")),
    "json_props": lambda spark, d: read(spark, d, "events").select("event_id", F.size(F.json_object_keys("props")).alias("n_keys")),
    "json_repair": lambda spark, d: _json_rows(spark, d).select("event_id", F.get_json_object("fixed", "$.note").alias("note"), F.try_parse_json("fixed").isNotNull().alias("parses")),
    "page_window": _pages,
}

SQL = {
    "triple_dedup_last": f"WITH {TRIPLES} SELECT subject_id, predicate, object_id, source, section_key, evidence FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id, source, section_key ORDER BY ord DESC) AS r FROM t) WHERE r = 1",
    "rule_dedup": f"""WITH {TRIPLES} SELECT subject_id, predicate, object_id, source AS object_name, section_key, evidence, first_ord FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id, source, section_key ORDER BY ord DESC) AS r,
 min(ord) OVER (PARTITION BY subject_id, predicate, object_id, source, section_key) AS first_ord FROM t) WHERE r = 1""",
    "term_dictionary": "SELECT lower(p_name) AS key, arg_max(p_partkey, p_partkey)::VARCHAR AS value, min(p_partkey) AS ordinal FROM part GROUP BY lower(p_name)",
    "entity_upsert": """WITH e AS (SELECT 'E' || n_nationkey AS entity_id, 'Chapter' AS entity_type, n_name AS entity_name, 0 AS rank, n_nationkey::BIGINT AS ord FROM nation
 UNION ALL SELECT 'E' || (s_suppkey % 40), 'KnowledgePoint', s_name, 1, s_suppkey FROM supplier) SELECT entity_id, entity_type, entity_name FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rank DESC, ord DESC) AS r FROM e) WHERE r = 1""",
    "fuse_report": f"WITH {TRIPLES} SELECT 'predicate' AS dimension, predicate AS value, count(*) AS n FROM t GROUP BY predicate UNION ALL SELECT 'source', source, count(*) FROM t GROUP BY source",
    "rdf_lines": f"""WITH {TRIPLES}, e AS (SELECT 'E' || n_nationkey AS entity_id, 'Chapter' AS entity_type, n_name AS entity_name, 0 AS rank, n_nationkey::BIGINT AS ord FROM nation
 UNION ALL SELECT 'E' || (s_suppkey % 40), 'KnowledgePoint', s_name, 1, s_suppkey FROM supplier), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rank DESC, ord DESC) AS r FROM e) WHERE r = 1)
SELECT 1 AS part, entity_id AS key, 'ckg:' || entity_id || ' a ckg:' || entity_type || ' ; rdfs:label "' || entity_name || '" .' AS line FROM u
UNION SELECT 2, subject_id || '|' || predicate || '|' || object_id, 'ckg:' || subject_id || ' ckg:' || lower(predicate) || ' ckg:' || object_id || ' .' FROM t WHERE object_id IS NOT NULL""",
    "slug_ids": "SELECT p_partkey, 'SEC_' || trim(regexp_replace(p_type || ' / (' || p_brand || ')', '[^A-Za-z0-9_.\\-]+', '_', 'g'), '_') AS node FROM part",
    "adjacent_edges": "SELECT * FROM (SELECT conv_id, conv_id || '-' || turn AS src, lead(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE dst IS NOT NULL",
    "seq_ids": "SELECT conv_id, turn, 9000 + row_number() OVER (ORDER BY conv_id, turn) AS seq, 'KP' || (9000 + row_number() OVER (ORDER BY conv_id, turn)) AS seq_id FROM conversations",
    "round_robin": "SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) % 7 AS slot FROM conversations",
    "chapter_rollup": """WITH s AS (SELECT (doc_id % 20)::VARCHAR AS chapter_id, count(*) AS sections, sum(n_chars)::BIGINT AS chars, sum(doc_id % 3)::BIGINT AS code_blocks FROM documents GROUP BY 1)
SELECT n_nationkey::VARCHAR AS chapter_id, coalesce(sections, 0) AS sections, coalesce(chars, 0) AS chars, coalesce(code_blocks, 0) AS code_blocks FROM nation LEFT JOIN s ON s.chapter_id = n_nationkey::VARCHAR""",
    "priority_lookup": """WITH p AS (SELECT p_name AS name, p_partkey AS k FROM part),
n AS (SELECT key, max('N' || k) AS v FROM (SELECT regexp_replace(lower(CASE WHEN k % 5 = 0 THEN name ELSE name || '!' END), '\\s+', '', 'g') AS key, k FROM p) GROUP BY key),
o AS (SELECT key, max('O' || k) AS v FROM (SELECT regexp_replace(lower(CASE WHEN k % 2 = 0 THEN name ELSE name || '!' END), '\\s+', '', 'g') AS key, k FROM p) GROUP BY key),
l AS (SELECT k, CASE k % 6 WHEN 0 THEN upper(name) WHEN 3 THEN name || '?' WHEN 1 THEN name || '!' ELSE name END AS name FROM p)
SELECT l.name, l.k, coalesce(n.v, o.v) AS kp_id FROM l LEFT JOIN n ON n.key = regexp_replace(lower(l.name), '\\s+', '', 'g') LEFT JOIN o ON o.key = regexp_replace(lower(l.name), '\\s+', '', 'g')""",
    "job_state": "SELECT job_id, seq, status, value FROM (SELECT user_id % 200 AS job_id, event_id AS seq, event_type AS status, value, row_number() OVER (PARTITION BY user_id % 200 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "review_latest": """WITH e AS (SELECT 'REV' || (user_id % 300) AS id, event_id AS seq, ['pending', 'approved', 'rejected'][event_id % 3 + 1] AS status FROM events),
k AS (SELECT *, max(CASE WHEN status <> 'approved' THEN seq END) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS anchor FROM e),
x AS (SELECT k.*, a.status AS anchor_status FROM k LEFT JOIN e a ON a.id = k.id AND a.seq = k.anchor)
SELECT id, status, seq FROM (SELECT id, CASE WHEN status = 'approved' THEN CASE WHEN anchor_status = 'rejected' THEN 'rejected' ELSE 'approved' END ELSE status END AS status, seq, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM x) WHERE r = 1""",
    "json_props": "SELECT event_id, len(json_keys(props))::INTEGER AS n_keys FROM events",
    "json_repair": "SELECT event_id, 'x y' AS note, true AS parses FROM events WHERE props IS NOT NULL",
    "page_window": """WITH p AS (SELECT 'job' AS job_id, page_id::INTEGER AS page, html AS text FROM pages) SELECT * FROM p WHERE page BETWEEN greatest(1, least(5, (SELECT max(page) FROM p))) AND least(9, (SELECT max(page) FROM p)) UNION ALL SELECT * FROM p WHERE page <= 40""",
}
