"""Lasting tables, uploads and SQL-only queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from ..functions import prompts
from ..operators import imports, review, snapshots
from ..sources import uploads
from . import graphview as v
from .graph_queries import SQL as GRAPH_SQL
from .graph_queries import merge_rows
from .graphview import read
from .staging import new_path


def _stored(spark, d):
    """The merge of merge_nodes through a table that lasts."""
    path = new_path(spark)
    snapshots.create(v.graph(spark, d).kps.select("kp_id", "name", "section", "chapter_id"), path, ["kp_id"])
    snapshots.merge_nodes(path, merge_rows(spark, d), ["name", "section"])
    return snapshots.read(spark, path)


#: Rows of an uploaded file.
LOT = 100


def _uploads(spark, d):
    """Parts come as JSON lists, one lot in seven of which breaks off; suppliers as CSV."""
    lot = lambda df, key, row: df.groupBy(F.floor(F.col(key) / LOT).alias("lot")).agg(F.sort_array(F.collect_list(F.struct(key, row.alias("row")))).alias("rows"))
    part = read(spark, d, "part")
    j = lot(part, "p_partkey", F.to_json(F.struct(v._key("KP", F.col("p_partkey"), 6).alias("kp_id"), F.col("p_name").alias("name"), F.col("p_size").alias("level"))))
    text = F.concat(F.lit("["), F.array_join("rows.row", ","), F.when(F.col("lot") % 7 == 3, "").otherwise("]"))
    c = lot(read(spark, d, "supplier"), "s_suppkey", F.concat(v._key("KP", F.col("s_suppkey") * 2, 6), F.lit(',"'), F.col("s_name"), F.lit('"')))
    files = j.select(F.concat(F.lit("up/part"), F.col("lot").cast("string"), F.lit(".json")).alias("file"), text.cast("binary").alias("content")).unionAll(
        c.select(F.concat(F.lit("up/kp"), F.col("lot").cast("string"), F.lit(".csv")), F.concat(F.lit("kp_id,name\n"), F.array_join("rows.row", "\n")).cast("binary")))
    items, errors = uploads.parse(files)
    at = lambda k: F.element_at("data", k)
    return uploads.kps(items, v.graph(spark, d).kps).select("file", "pos", at("kp_id").alias("kp_id"), at("name").alias("name"), at("level").alias("level"), at("status").alias("status")).unionAll(
        errors.select("file", F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), "error"))


_SOURCES = """SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN 'int f(int n) { return f(n - 1); }' WHEN 1 THEN 'void g() { for (;;) while (b()) c(); }' WHEN 2 THEN 'void h() { switch (x) { } }' ELSE 'void i() { {' END,
 '/* ', replace(html, '*/', ''), ' */') AS source FROM parquet.`{d}/pages.parquet`"""


def _sql_patterns(spark, d):
    sql.register(spark)
    return spark.sql("SELECT page_id, pattern, parsed FROM code_patterns(TABLE(" + _SOURCES.replace("{d}", d) + ") PARTITION BY page_id)")


def _sql_near(spark, d):
    sql.register(spark)
    return spark.sql(f"SELECT n_name, r_name, kg_norm(concat(' ', n_name, '（', r_name, '）')) AS name, round(kg_jaccard(n_name, r_name), 6) AS similarity FROM parquet.`{d}/nation.parquet` JOIN parquet.`{d}/region.parquet` ON n_regionkey = r_regionkey")


def _imported(spark, d):
    """Suppliers are imported: each names the part of its number, itself, and a name that nothing has; some chapters aren't there."""
    x = v.graph(spark, d)
    text = lambda c: F.lit(None).cast("string").alias(c)
    nodes = x.kps.select("kp_id", "name", "chapter_id", "section", "aliases", *[text(c) for c in ("category", "summary", "description", "code_example")], "source", F.lit(True).alias("reviewed"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    found = read(spark, d, "supplier").join(p, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), v._key("CH", F.col("s_suppkey") % 28, 2).alias("chapter_id"), *[text(c) for c in imports.IMPORTED[2:]],
        F.array(F.upper("p_name"), F.concat(F.lit("no "), "s_name")).alias("prerequisites"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.concat(F.lit(" "), F.lower("s_name")), F.lit(""))).alias("related"))
    n, e, report = imports.import_extracted(nodes, x.edges, x.chapters, found)
    told = report.select(F.lit("report").alias("kind"), F.concat_ws("/", "imported", "prerequisites", "missed_prerequisites", "related", "missed_related").alias("a"), text("b"), text("c"))
    return told.unionAll(n.select(F.lit("node"), "kp_id", "name", F.concat_ws("|", "source", "category", "chapter_id"))).unionAll(e.select(F.lit("edge"), "src", "dst", "type"))


def _to_review(spark, d):
    data = lambda *pairs: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in pairs]).alias("data")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), data("chapter_id", v._key("CH", F.col("n_nationkey"), 2)))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("ord"), data("kp_id", v._key("KP", F.col("c_custkey"), 6)))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), data("source", v._key("KP", F.col("s_suppkey"), 6)))
    q = review.numbered(imports.to_review("J1", n, c, s, v.graph(spark, d).kps))
    return q.select("id", "type", "action", "status", "source", F.array_join(F.map_values("data"), ",").alias("value"))


def _explained(spark, d):
    """Prompts for every node: sources with and without a book, pages, nothing."""
    k = v.graph(spark, d).kps
    lost = lambda n, c: F.when(F.col("source_page") % n != 0, F.col(c))
    node = {"chapter_id": lost(3, "chapter_id"), "section": lost(4, "section"), "aliases": lost(5, "aliases"), "source_book": lost(2, "source_book"), "source": lost(6, "source"),
            "source_page": F.col("source_page") % 7, "source_pages": F.when(F.col("source_page") % 8 == 0, "3-5")}
    return k.select("kp_id", prompts.explain(F.col("name"), node).alias("explain"), prompts.recommend(F.col("name")).alias("recommend"), prompts.code_review(F.col("aliases")).alias("review"))


QUERIES = {"import_extracted": _imported, "extract_to_review": _to_review, "node_prompts": _explained, "stored_merge": _stored, "uploaded_rows": _uploads, "sql_code_patterns": _sql_patterns, "sql_functions": _sql_near}

_Q = lambda t: "'" + t.replace("'", "''") + "'"


def _prompt_sql(template: str, values: dict[str, str]) -> str:
    parts, rest = [], template
    for key, value in values.items():
        before, _, rest = rest.partition("{" + key + "}")
        parts += [_Q(before), value]
    return " || ".join([*parts, _Q(rest)])


_IF = lambda n, c: f"CASE WHEN source_page % {n} <> 0 THEN {c} END"
SQL = {
    "import_extracted": "WITH " + v.SQL + """, new AS (SELECT s_suppkey AS k, 'KP' || (9000 + row_number() OVER (ORDER BY s_suppkey)) AS id, s_name, 'CH' || lpad((s_suppkey % 28)::VARCHAR, 2, '0') AS ch, p_name FROM supplier LEFT JOIN part ON p_partkey = s_suppkey),
old AS (SELECT lower(replace(name, ' ', '')) AS key, max(kp_id) AS id FROM kps GROUP BY 1),
l AS (SELECT id AS o, 'PREREQUISITE' AS type, lower(replace(p_name, ' ', '')) AS key FROM new UNION ALL SELECT id, 'PREREQUISITE', lower(replace('no ' || s_name, ' ', '')) FROM new
 UNION ALL SELECT id, 'RELATED', lower(replace(s_name, ' ', '')) FROM new WHERE k % 2 = 0 UNION ALL SELECT id, 'RELATED', NULL FROM new WHERE k % 2 = 0),
h AS (SELECT l.o, l.type, coalesce(n.id, old.id) AS id FROM l LEFT JOIN (SELECT lower(replace(s_name, ' ', '')) AS key, max(id) AS id FROM new GROUP BY 1) n USING (key) LEFT JOIN old USING (key)),
e AS (SELECT ch AS src, id AS dst, 'CONTAINS' AS type FROM new WHERE ch IN (SELECT chapter_id FROM chapters) UNION SELECT CASE WHEN type = 'RELATED' THEN o ELSE id END, CASE WHEN type = 'RELATED' THEN id ELSE o END, type FROM h WHERE id IS NOT NULL)
SELECT 'report' AS kind, (SELECT count(*) FROM new) || '/' || count(*) FILTER (type = 'PREREQUISITE' AND id IS NOT NULL) || '/' || count(*) FILTER (type = 'PREREQUISITE' AND id IS NULL) || '/' || count(*) FILTER (type = 'RELATED' AND id IS NOT NULL) || '/' || count(*) FILTER (type = 'RELATED' AND id IS NULL) AS a, NULL AS b, NULL AS c FROM h
UNION ALL SELECT 'node', coalesce(id, kp_id), coalesce(s_name, name), CASE WHEN id IS NOT NULL THEN 'ai_extracted|other|' || ch ELSE 'seed|' || chapter_id END FROM kps FULL JOIN new ON id = kp_id
UNION ALL SELECT 'edge', src, dst, type FROM edges UNION ALL (SELECT 'edge', src, dst, type FROM e WHERE (src, dst, type) NOT IN (SELECT (src, dst, type) FROM edges))""",
    "extract_to_review": "WITH " + v.SQL + """, q AS (SELECT 0 AS p, n_nationkey::BIGINT AS o, 'chapter' AS type, 'add' AS action, 'CH' || lpad(n_nationkey::VARCHAR, 2, '0') AS value FROM nation
 UNION ALL SELECT 1, c_custkey, 'kp', CASE WHEN c_custkey IN (SELECT p_partkey FROM part) THEN 'update' ELSE 'add' END, 'KP' || lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INTEGER, '0') FROM customer
 UNION ALL SELECT 2, s_suppkey, 'relation', 'add', 'KP' || lpad(s_suppkey::VARCHAR, greatest(6, length(s_suppkey::VARCHAR))::INTEGER, '0') FROM supplier), n AS (SELECT *, row_number() OVER (ORDER BY p, o) AS r FROM q)
SELECT 'REV' || lpad(r::VARCHAR, greatest(3, length(r::VARCHAR))::INTEGER, '0') AS id, type, action, 'pending' AS status, 'PDF抽取:J1' AS source, value FROM n""",
    "node_prompts": "WITH " + v.SQL + " SELECT kp_id, " + _prompt_sql(prompts.EXPLAIN, {
        "name": "name", "chapter_id": f"coalesce({_IF(3, 'chapter_id')}, '未知')", "section": f"coalesce({_IF(4, 'section')}, '未知')", "aliases": f"coalesce({_IF(5, 'aliases')}, '无')",
        "book": f"coalesce({_IF(2, 'source_book')}, {_IF(6, 'source')}, '未记录')",
        "pages": "CASE WHEN source_page % 8 = 0 THEN '3-5' WHEN source_page % 7 <> 0 THEN '第 ' || (source_page % 7) || ' 页' ELSE '未记录' END"}) + " AS explain, "
        + _prompt_sql(prompts.RECOMMEND, {"name": "name"}) + " AS recommend, " + _prompt_sql(prompts.REVIEW, {"code": "aliases"}) + " AS review FROM kps",
    "stored_merge": GRAPH_SQL["merge_nodes"],
    "uploaded_rows": "WITH " + v.SQL + f""", j AS (SELECT kp_id, name, source_page AS level, substr(kp_id, 3)::BIGINT // {LOT} AS lot, substr(kp_id, 3)::BIGINT AS k FROM kps),
c AS (SELECT s_suppkey // {LOT} AS lot, s_suppkey AS k, 'KP' || lpad((s_suppkey * 2)::VARCHAR, greatest(6, length((s_suppkey * 2)::VARCHAR))::INTEGER, '0') AS kp_id, s_name AS name FROM supplier)
SELECT 'up/part' || lot || '.json' AS file, (row_number() OVER (PARTITION BY lot ORDER BY k) - 1)::INTEGER AS pos, kp_id, name, level::VARCHAR AS level, 'new' AS status FROM j WHERE lot % 7 <> 3
UNION ALL SELECT DISTINCT 'up/part' || lot || '.json', NULL, NULL, NULL, NULL, 'not JSON' FROM j WHERE lot % 7 = 3
UNION ALL SELECT 'up/kp' || lot || '.csv', (row_number() OVER (PARTITION BY lot ORDER BY k) - 1)::INTEGER, kp_id, name, NULL, CASE WHEN kp_id IN (SELECT kp_id FROM kps) THEN 'update' ELSE 'new' END FROM c""",
    "sql_code_patterns": "SELECT page_id, unnest(CASE page_id % 4 WHEN 0 THEN ['Recursion'] WHEN 1 THEN ['For', 'While'] WHEN 2 THEN ['Switch'] ELSE [NULL] END) AS pattern, page_id % 4 <> 3 AS parsed FROM pages",
    "sql_functions": """WITH c AS (SELECT n_name, r_name, list_distinct(string_split(lower(n_name), '')) AS a, list_distinct(string_split(lower(r_name), '')) AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_name, r_name, replace(n_name || '(' || r_name || ')', ' ', '') AS name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM c""",
}
