"""Graph reads, analytics and upserts over the graph view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as a
from ..operators import graph as g
from ..operators import review, store
from . import graphview as v
from .staging import cut, drop

CHAPTER, NODE, WORD = "CH07", "KP000042", "ring"
WITH = "WITH RECURSIVE " + v.SQL
KP = ", ".join(g.KP_COLUMNS)


def _graph(f):
    return lambda spark, d: f(v.graph(spark, d))


def _dag(x):
    return x.of_type("PREREQUISITE").select("src", "dst")


def _main(x):
    """A longest chain by edge order: nodes are numbered, so an edge's name is its order."""
    e = _dag(x).withColumn("ord", F.concat_ws("|", "src", "dst"))
    return a.main_chain(e)


def _kp_nodes(x):
    return a.backbone(_dag(x))


def _typed(x):
    return x.nodes().select("id", "type")


def merge_rows(spark, d):
    return v.read(spark, d, "lineitem").select(
        v._key("KP", F.col("l_partkey") * 2, 6).alias("kp_id"), F.concat(F.lit("part "), F.col("l_suppkey").cast("string")).alias("name"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("section"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_partkey").alias("ord"))


def _merge_nodes(spark, d):
    return store.merge_nodes(v.graph(spark, d).kps.select("kp_id", "name", "section", "chapter_id"), merge_rows(spark, d), "kp_id", ["name", "section"])


def _merge_edges(spark, d):
    x = v.graph(spark, d)
    base = x.of_type("RELATED").withColumn("description", F.lit("base"))
    rows = v.read(spark, d, "lineitem").select(v._key("KP", F.col("l_partkey"), 6).alias("src"), v._key("KP", F.col("l_suppkey"), 6).alias("dst"), F.lit("RELATED").alias("type"),
                                              F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("description"), F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").alias("ord"))
    return store.merge_edges(base, rows)


def _detach(x):
    gone = x.kps.where("section = 'Brand#11'").select(F.col("kp_id").alias("id"))
    nodes, edges = store.detach_delete(x.kps, x.edges, gone, "kp_id")
    return nodes.select(F.lit("node").alias("kind"), F.col("kp_id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).unionAll(edges.select(F.lit("edge"), "src", "dst", "type"))


def _exists(spark, d):
    x = v.graph(spark, d)
    rows = v.read(spark, d, "orders").select(v._key("KP", F.col("o_custkey"), 6).alias("kp_id")).distinct()
    from ..operators.resolve import found_action

    return found_action(rows, x.kps, "kp_id")


def _reach(x):
    """All that the query set, the nodes whose number is divisible by 50, reach over the edges of every type: pairs of all nodes grow with their square."""
    edges = cut(x.edges.select("src", "dst"))
    starts = a.backbone(edges).where("cast(substring(node, 3) as bigint) % 50 = 0")
    found = a.reachable_both(edges, starts)
    drop(edges)
    return found


def _next(spark, d):
    """From each part to the part that follows it most often in an order, the least on ties: a graph full of cycles."""
    n = v.follows(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("b"))
    e = n.select(v._key("KP", F.col("a"), 6).alias("src"), v._key("KP", F.col("b"), 6).alias("dst"))
    return e.withColumn("ord", F.concat_ws("|", "src", "dst"))


def _focus(x):
    ids, edges = a.focus(_dag(x), NODE)
    return ids.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).unionAll(edges.select(F.lit("edge"), "src", "dst"))


def _subgraph(x):
    nodes, edges = g.subgraph_by_chapter(x, CHAPTER)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), "type").unionAll(edges.select(F.lit("edge"), "src", "dst", "type"))


def _slots(x):
    e = x.of_type("EXAMPLE_OF").select(F.lit("example").alias("role"), F.col("dst").alias("anchor"), F.col("src").alias("id"))
    return a.slots(e.unionAll(x.of_type("CONTAINS").select(F.lit("kp"), "src", "dst"))).select("role", "anchor", "id", "slot", "n", "offset")


def _replay(spark, d):
    """All events are the base and the log as well; the log has nodes from 500 on that the base doesn't."""
    e = v.read(spark, d, "events")
    node = (F.col("user_id") % 600).cast("string")
    base = e.groupBy((F.col("user_id") % 500).cast("string").alias("node")).agg(F.max("event_type").alias("label"), F.max(F.col("value").cast("string")).alias("value"))
    action = F.when(F.col("event_id") % 11 == 0, "delete").when(F.col("event_id") % 3 == 0, "add").otherwise("update")
    items = e.select(F.col("event_id").alias("seq"), action.alias("action"), node.alias("node"), F.nullif(F.col("event_type"), F.lit("click")).alias("label"), F.col("value").cast("string").alias("value"))
    return review.replay(base, items, "node", ["label", "value"]).select("node", "label", F.col("value").cast("double").alias("value"))


QUERIES = {
    "health": lambda spark, d: g.health(spark),
    "graph_stats": _graph(g.stats),
    "list_chapters": _graph(g.list_chapters),
    "chapter_detail": _graph(g.chapter_kps),
    "chapter_page": _graph(lambda x: g.chapter_detail(x, CHAPTER)),
    "search_topk": _graph(lambda x: g.search_kps(x, WORD)),
    "editor_search": _graph(lambda x: g.editor_search(x, "00001")),
    "point_lookup": _graph(lambda x: g.lookup(x, NODE)),
    "out_neighbors": _graph(lambda x: g.out_neighbors(x, "PREREQUISITE")),
    "in_neighbors": _graph(lambda x: g.in_neighbors(x, "PREREQUISITE")),
    "undirected_neighbors": _graph(lambda x: g.undirected_neighbors(x, NODE)),
    "graph_nodes": _graph(lambda x: g.export_nodes(x).select("id", "label", "type")),
    "graph_edges": _graph(g.export_edges),
    "subgraph_by_chapter": _graph(_subgraph),
    "topk_chapters": _graph(g.top_chapters),
    "type_counts": _graph(g.type_counts),
    "kp_card": _graph(g.kp_card),
    "backbone": _graph(_kp_nodes),
    "layer_depth": _graph(lambda x: a.layer_depth(_kp_nodes(x), _dag(x))),
    "main_chain_height": _graph(lambda x: a.heights(_dag(x))),
    "main_chain": _graph(_main),
    "reachability": _graph(_reach),
    "focus_subgraph": _graph(_focus),
    "cycle_components": lambda spark, d: a.components(_next(spark, d)),
    "cycle_heights": lambda spark, d: a.heights(_next(spark, d)),
    "cycle_chain": lambda spark, d: a.main_chain(_next(spark, d)),
    "roles": _graph(lambda x: a.roles(_typed(x), x.edges, _main(x))),
    "style_roles": _graph(lambda x: a.style_roles(_typed(x), x.edges, _main(x))),
    "nearest_main": _graph(lambda x: a.nearest_main(_typed(x), x.edges, _main(x))),
    "chain_edges": _graph(lambda x: a.chain_edges(_dag(x).withColumn("ord", F.concat_ws("|", "src", "dst")), _main(x))),
    "slots": _graph(_slots),
    "in_degree": _graph(lambda x: a.degrees(_typed(x), x.edges)),
    "layered_positions": _graph(lambda x: a.layered_positions(a.layer_depth(_kp_nodes(x), _dag(x)), x.kps.select(F.col("kp_id").alias("node"), F.col("name").alias("label")))),
    "merge_nodes": _merge_nodes,
    "merge_edges": _merge_edges,
    "detach_delete": _graph(_detach),
    "exists_action": _exists,
    "unique_violations": lambda spark, d: store.violations(v.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "apply_replay": _replay,
}

# A longest chain in SQL: heights first, then at each node the successor of most height, the first name on ties.
_HEIGHTS = """
down AS (SELECT dst AS node, 1 AS h FROM dag UNION SELECT src, 1 FROM dag UNION SELECT d.src, down.h + 1 FROM dag d JOIN down ON d.dst = down.node),
heights AS (SELECT node, max(h)::INTEGER AS height FROM down GROUP BY node),
best AS (SELECT src, dst FROM (SELECT d.src, d.dst, row_number() OVER (PARTITION BY d.src ORDER BY h.height DESC, d.src || '|' || d.dst) AS r FROM dag d JOIN heights h ON d.dst = h.node) WHERE r = 1),
head AS (SELECT h.node FROM heights h JOIN (SELECT src, min(src || '|' || dst) AS ord FROM dag GROUP BY src) f ON f.src = h.node WHERE h.node NOT IN (SELECT dst FROM dag) ORDER BY h.height DESC, f.ord LIMIT 1),
main AS (SELECT 0 AS position, node FROM head UNION ALL SELECT m.position + 1, b.dst FROM main m JOIN best b ON m.node = b.src)
"""
_NODES = "nodes AS (SELECT kp_id AS id, name AS label, 'knowledge_point' AS type FROM kps UNION ALL SELECT chapter_id, title, 'chapter' FROM chapters UNION ALL SELECT example_id, name, 'example' FROM examples)"
_BACK = "bb AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag)"
_DEPTH = "up AS (SELECT node, 0 AS d FROM bb WHERE node NOT IN (SELECT dst FROM dag) UNION SELECT e.dst, up.d + 1 FROM dag e JOIN up ON e.src = up.node), depth AS (SELECT node, max(d)::INTEGER AS depth FROM up GROUP BY node)"


def _beside(name: str, types: str) -> str:
    return f"{name} AS (SELECT e.src AS id FROM edges e JOIN main m ON e.dst = m.node WHERE e.type IN ({types}) UNION SELECT e.dst FROM edges e JOIN main m ON e.src = m.node WHERE e.type IN ({types}))"


def _touch(name: str, kind: str) -> str:
    return f"{name} AS (SELECT src AS id FROM edges WHERE type = '{kind}' UNION SELECT dst FROM edges WHERE type = '{kind}')"


_ROLE = """SELECT n.id, CASE {example}WHEN m.position = 0 THEN 'entry' WHEN m.position IS NOT NULL THEN 'main' WHEN n.id IN (SELECT id FROM b1) THEN 'branch'
 WHEN n.id IN (SELECT id FROM b2) THEN 'extension' WHEN n.id IN (SELECT id FROM b3) THEN 'related' ELSE 'isolated' END AS role FROM nodes n LEFT JOIN main m ON n.id = m.node"""
_WALK = """{0} AS (SELECT s.node AS start, e.{2} AS node, 1 AS distance FROM starts s JOIN dag e ON e.{1} = s.node UNION SELECT w.start, e.{2}, w.distance + 1 FROM {0} w JOIN dag e ON e.{1} = w.node)"""
# Links lead round, so a pair is kept once, from the round that finds it.
_NEAREST = """{0}(start, node, distance) USING KEY (start, node) AS (SELECT s.node, e.{2}, 1 FROM starts s JOIN links e ON e.{1} = s.node UNION
SELECT w.start, e.{2}, w.distance + 1 FROM {0} w JOIN links e ON e.{1} = w.node WHERE NOT EXISTS (SELECT 1 FROM recurring.{0} r WHERE r.start = w.start AND r.node = e.{2}))"""
# Who leads to whom in a graph of one edge a node, its components, and the components on the path from each.
_CYCLES = """
nxt AS (SELECT 'KP' || lpad(a::VARCHAR, greatest(6, length(a::VARCHAR))::INTEGER, '0') AS src, 'KP' || lpad(b::VARCHAR, greatest(6, length(b::VARCHAR))::INTEGER, '0') AS dst
  FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS r FROM follows WHERE b IS NOT NULL AND a <> b GROUP BY a, b) WHERE r = 1),
lead AS (SELECT src, dst FROM nxt UNION SELECT l.src, n.dst FROM lead l JOIN nxt n ON n.src = l.dst),
names AS (SELECT src AS node FROM nxt UNION SELECT dst FROM nxt),
comp AS (SELECT n.node, least(n.node, coalesce(min(back.src), n.node)) AS component FROM names n LEFT JOIN (SELECT a.src AS node, a.dst AS src FROM lead a JOIN lead b ON a.src = b.dst AND a.dst = b.src) back ON back.node = n.node GROUP BY n.node),
tall AS (SELECT c.node, c.component, 1 + count(DISTINCT CASE WHEN f.component <> c.component THEN f.component END) AS height FROM comp c LEFT JOIN lead l ON l.src = c.node LEFT JOIN comp f ON f.node = l.dst GROUP BY c.node, c.component)
"""

SQL = {
    "cycle_components": WITH + f", {_CYCLES} SELECT node, component FROM comp",
    "cycle_heights": WITH + f", {_CYCLES} SELECT node, height::INTEGER AS height FROM tall",
    "cycle_chain": WITH + f""", {_CYCLES}, entered AS (SELECT d.component FROM nxt JOIN comp s ON s.node = src JOIN comp d ON d.node = dst WHERE s.component <> d.component),
head AS (SELECT t.component AS node FROM tall t JOIN nxt ON nxt.src = t.node WHERE t.component NOT IN (SELECT component FROM entered) ORDER BY t.height DESC, src || '|' || dst LIMIT 1)
SELECT (h.height - t.height)::INTEGER AS position, t.component AS node FROM head JOIN tall h ON h.node = head.node JOIN (SELECT DISTINCT component, height FROM tall) t ON t.component = head.node
  OR t.component IN (SELECT f.component FROM comp c JOIN lead l ON l.src = c.node JOIN comp f ON f.node = l.dst WHERE c.component = head.node)""",
    "health": "SELECT 1 AS ok",
    "graph_stats": WITH + """SELECT CASE WHEN c = 0 OR r = 0 THEN 0 ELSE k END AS total_kps, CASE WHEN c = 0 OR r = 0 THEN 0 ELSE c END AS total_chapters, CASE WHEN c = 0 OR r = 0 THEN 0 ELSE r END AS total_relations, 0::BIGINT AS total_segments
FROM (SELECT count(*) AS c FROM chapters), (SELECT count(*) AS k FROM kps), (SELECT count(*) AS r FROM edges)""",
    "list_chapters": WITH + 'SELECT chapter_id, title, "order" FROM chapters',
    "chapter_detail": WITH + f"""SELECT c.chapter_id AS in_chapter, c.title, c."order", {KP.replace('kp_id', 'k.kp_id').replace('chapter_id', 'k.chapter_id')} FROM chapters c JOIN edges e ON e.src = c.chapter_id AND e.type = 'CONTAINS' JOIN kps k ON k.kp_id = e.dst""",
    "chapter_page": WITH + f"""SELECT c.chapter_id AS in_chapter, c.title, c."order", {KP.replace('kp_id', 'k.kp_id').replace('chapter_id', 'k.chapter_id')} FROM chapters c JOIN edges e ON e.src = c.chapter_id AND e.type = 'CONTAINS' JOIN kps k ON k.kp_id = e.dst WHERE c.chapter_id = '{CHAPTER}'""",
    "search_topk": WITH + f"SELECT {KP} FROM kps WHERE contains(name, '{WORD}') OR contains(coalesce(aliases, ''), '{WORD}') ORDER BY chapter_id, section, kp_id LIMIT {g.SEARCH_LIMIT}",
    "editor_search": WITH + f"SELECT {KP} FROM kps WHERE contains(name, '00001') OR contains(coalesce(kp_id, ''), '00001')",
    "point_lookup": WITH + f"SELECT {KP} FROM kps WHERE kp_id = '{NODE}'",
    "out_neighbors": WITH + f"SELECT e.src, {KP} FROM dag e JOIN kps ON kps.kp_id = e.dst",
    "in_neighbors": WITH + f"SELECT e.dst, {KP} FROM dag e JOIN kps ON kps.kp_id = e.src",
    "undirected_neighbors": WITH + f"""SELECT {KP} FROM (SELECT dst AS far FROM edges WHERE type = 'RELATED' AND src = '{NODE}' UNION ALL SELECT src FROM edges WHERE type = 'RELATED' AND dst = '{NODE}' AND src <> '{NODE}')
JOIN kps ON kp_id = far ORDER BY kp_id LIMIT {g.RELATED_LIMIT}""",
    "graph_nodes": WITH + f", {_NODES} SELECT id, label, type FROM nodes ORDER BY id LIMIT {g.NODE_LIMIT}",
    "graph_edges": WITH + f""", {_NODES} SELECT src || '|' || type || '|' || dst AS id, src AS source, dst AS target, type AS label, type FROM edges
WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) ORDER BY source, target, type LIMIT {g.EDGE_LIMIT}""",
    "subgraph_by_chapter": WITH + f""", inside AS (SELECT kp_id AS id, 'knowledge_point' AS type FROM kps WHERE chapter_id = '{CHAPTER}' UNION ALL SELECT example_id, 'example' FROM examples WHERE chapter_id = '{CHAPTER}')
SELECT 'node' AS kind, id AS a, '' AS b, type FROM inside UNION ALL SELECT 'edge', src, dst, type FROM edges WHERE src IN (SELECT id FROM inside) AND dst IN (SELECT id FROM inside)""",
    "topk_chapters": WITH + f'SELECT chapter_id, title, "order" FROM chapters ORDER BY "order", chapter_id LIMIT {g.TOP_CHAPTERS}',
    "type_counts": WITH + f", {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type",
    "kp_card": WITH + """SELECT kp_id, name, 'book · 第 ' || source_page || ' 页' AS source_text, '位于 ' || section || '；别名：' || aliases || '；来源：book · 第 ' || source_page || ' 页' AS intro FROM kps""",
    "backbone": WITH + f", {_BACK} SELECT node FROM bb",
    "layer_depth": WITH + f", {_BACK}, {_DEPTH} SELECT node, depth FROM depth",
    "layered_positions": WITH + f""", {_BACK}, {_DEPTH} SELECT node, (row_number() OVER (PARTITION BY depth ORDER BY coalesce(name, ''), node) - 1) * 160.0::DOUBLE - (count(*) OVER (PARTITION BY depth) - 1) * 160.0::DOUBLE / 2 AS x, depth * 120.0::DOUBLE AS y FROM depth LEFT JOIN kps ON kp_id = node""",
    "main_chain_height": WITH + f", {_HEIGHTS} SELECT node, height FROM heights",
    "main_chain": WITH + f", {_HEIGHTS} SELECT position, node FROM main",
    "reachability": WITH + f""", links AS (SELECT DISTINCT src, dst FROM edges), starts AS (SELECT node FROM (SELECT src AS node FROM links UNION SELECT dst FROM links) WHERE substr(node, 3)::BIGINT % 50 = 0),
{_NEAREST.format('fwd', 'src', 'dst')}, {_NEAREST.format('bwd', 'dst', 'src')}
SELECT 'forward' AS direction, start, node, distance::INTEGER AS distance FROM fwd UNION ALL SELECT 'backward', start, node, distance::INTEGER FROM bwd""",
    "focus_subgraph": WITH + f""", starts AS (SELECT '{NODE}' AS node), {_WALK.format('fwd', 'src', 'dst')}, {_WALK.format('bwd', 'dst', 'src')}, ids AS (SELECT node FROM starts UNION SELECT node FROM fwd UNION SELECT node FROM bwd)
SELECT 'node' AS kind, node AS a, '' AS b FROM ids UNION ALL SELECT 'edge', src, dst FROM dag WHERE src IN (SELECT node FROM ids) AND dst IN (SELECT node FROM ids)""",
    "roles": WITH + f""", {_NODES}, {_HEIGHTS}, {_beside("b1", "'PREREQUISITE'")}, {_beside("b2", "'EXTENDS'")}, {_beside("b3", "'RELATED'")} """ + _ROLE.format(example="WHEN n.type = 'example' THEN 'example' "),
    "style_roles": WITH + f""", {_NODES}, {_HEIGHTS}, {_touch("b1", "PREREQUISITE")}, {_touch("b2", "EXTENDS")}, {_touch("b3", "RELATED")} """ + _ROLE.format(example=""),
    "nearest_main": WITH + f""", {_NODES}, {_HEIGHTS}, near AS (SELECT src AS id, dst AS node FROM edges WHERE type IN ('PREREQUISITE', 'EXTENDS', 'RELATED') UNION ALL SELECT dst, src FROM edges WHERE type IN ('PREREQUISITE', 'EXTENDS', 'RELATED'))
SELECT n.id, coalesce(x.p, 0)::INTEGER AS main_index FROM nodes n LEFT JOIN (SELECT id, min(position) AS p FROM near JOIN main USING (node) GROUP BY id) x ON n.id = x.id""",
    "chain_edges": WITH + f""", {_HEIGHTS} SELECT d.src, d.dst, d.src || '|' || d.dst AS ord, CASE WHEN b.position = a.position + 1 THEN 'main' ELSE 'aux' END AS kind FROM dag d LEFT JOIN main a ON d.src = a.node LEFT JOIN main b ON d.dst = b.node""",
    "slots": WITH + """, placed AS (SELECT 'example' AS role, dst AS anchor, src AS id FROM edges WHERE type = 'EXAMPLE_OF' UNION ALL SELECT 'kp', src, dst FROM edges WHERE type = 'CONTAINS'),
s AS (SELECT *, (row_number() OVER (PARTITION BY role, anchor ORDER BY id) - 1)::INTEGER AS slot, count(*) OVER (PARTITION BY role, anchor) AS n FROM placed)
SELECT role, anchor, id, slot, n, slot * 80.0::DOUBLE - (n - 1) * 80.0::DOUBLE / 2 AS "offset" FROM s""",
    "in_degree": WITH + f", {_NODES} SELECT n.id, coalesce(d.n, 0) AS in_degree FROM nodes n LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst) d ON n.id = d.id",
    "merge_nodes": WITH + """, rows AS (SELECT 'KP' || lpad((l_partkey * 2)::VARCHAR, greatest(6, length((l_partkey * 2)::VARCHAR))::INTEGER, '0') AS kp_id, 'part ' || l_suppkey AS name, nullif(l_returnflag, 'N') AS section,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_returnflag DESC) AS r FROM lineitem),
n AS (SELECT * FROM rows WHERE r = 1)
SELECT coalesce(k.kp_id, n.kp_id) AS kp_id, CASE WHEN n.kp_id IS NOT NULL THEN n.name ELSE k.name END AS name, CASE WHEN n.kp_id IS NOT NULL THEN n.section ELSE k.section END AS section, k.chapter_id FROM kps k FULL JOIN n ON k.kp_id = n.kp_id""",
    "merge_edges": WITH + """, n AS (SELECT 'KP' || lpad(l_partkey::VARCHAR, greatest(6, length(l_partkey::VARCHAR))::INTEGER, '0') AS src, 'KP' || lpad(l_suppkey::VARCHAR, greatest(6, length(l_suppkey::VARCHAR))::INTEGER, '0') AS dst, l_returnflag || ' ' || l_linestatus AS description,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_returnflag DESC, l_linestatus DESC) AS r FROM lineitem), m AS (SELECT * FROM n WHERE r = 1)
SELECT src, dst, 'RELATED' AS type, description FROM m UNION ALL SELECT p.src, p.dst, 'RELATED', 'base' FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.src = p.src AND m.dst = p.dst)""",
    "detach_delete": WITH + """, gone AS (SELECT kp_id FROM kps WHERE section = 'Brand#11')
SELECT 'node' AS kind, kp_id AS a, '' AS b, '' AS c FROM kps WHERE kp_id NOT IN (SELECT kp_id FROM gone) UNION ALL SELECT 'edge', src, dst, type FROM edges WHERE src NOT IN (SELECT kp_id FROM gone) AND dst NOT IN (SELECT kp_id FROM gone)""",
    "exists_action": WITH + """, r AS (SELECT DISTINCT 'KP' || lpad(o_custkey::VARCHAR, greatest(6, length(o_custkey::VARCHAR))::INTEGER, '0') AS kp_id FROM orders) SELECT kp_id, CASE WHEN kp_id IN (SELECT kp_id FROM kps) THEN 'update' ELSE 'add' END AS action FROM r""",
    "unique_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
}
