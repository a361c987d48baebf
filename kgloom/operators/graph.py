"""Reads of the property graph: lookup, search, expansion, statistics, export.

A graph is three node tables (chapters, kps, examples) and one edge table (src, dst, type). Limits that belong to an
endpoint take a total order first, so that results don't depend on the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the endpoints cut their results to.
SEARCH_LIMIT, RELATED_LIMIT, NODE_LIMIT, EDGE_LIMIT, TOP_CHAPTERS = 50, 10, 800, 1200, 24
KP_COLUMNS = ["kp_id", "name", "chapter_id", "section", "aliases", "source"]


#: Spark's collation for labels.
CHINESE = "zh"


@dataclass
class Graph:
    chapters: DataFrame
    kps: DataFrame
    examples: DataFrame
    edges: DataFrame

    def nodes(self) -> DataFrame:
        """(id, label, type, data) of the three exported labels; data is the node's properties as JSON."""
        def part(df: DataFrame, key: str, label: str, kind: str) -> DataFrame:
            return df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("type"), F.to_json(F.struct(*df.columns)).alias("data"))

        return (part(self.kps, "kp_id", "name", "knowledge_point").unionByName(part(self.chapters, "chapter_id", "title", "chapter"))
                .unionByName(part(self.examples, "example_id", "name", "example")))

    def of_type(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))


def health(spark) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("ok"))


def stats(g: Graph) -> DataFrame:
    """Counts; all zero if there is no chapter or no relation, as a chained match then has no row."""
    total = g.chapters.agg(F.count(F.lit(1)).alias("c")).crossJoin(g.kps.agg(F.count(F.lit(1)).alias("k"))).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("r")))
    none = (F.col("c") == 0) | (F.col("r") == 0)
    return total.select(*[F.when(none, F.lit(0).cast("bigint")).otherwise(F.col(c)).alias(n) for c, n in (("k", "total_kps"), ("c", "total_chapters"), ("r", "total_relations"))],
                        F.lit(0).cast("bigint").alias("total_segments"))


def list_chapters(g: Graph) -> DataFrame:
    return g.chapters.select("chapter_id", "title", "order").orderBy(F.col("order").asc_nulls_last(), "chapter_id")


def chapter_kps(g: Graph) -> DataFrame:
    """Every chapter with the knowledge points that its CONTAINS edges reach; the property chapter_id plays no part."""
    inside = g.of_type("CONTAINS").select(F.col("src").alias("in_chapter"), F.col("dst").alias("kp_id"))
    return (g.chapters.select(F.col("chapter_id").alias("in_chapter"), "title", "order").join(inside, "in_chapter")
            .join(g.kps.select(*KP_COLUMNS), "kp_id"))


def chapter_detail(g: Graph, chapter_id: str) -> DataFrame:
    return chapter_kps(g).where(F.col("in_chapter") == chapter_id).orderBy("section", "kp_id")


def contains(needle: str, *columns: str) -> Column:
    """Three-valued: a null first column and no hit elsewhere is null, and the row goes."""
    first, *rest = columns
    found = F.contains(F.col(first), F.lit(needle))
    for c in rest:
        found = found | F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(needle))
    return found


def search_kps(g: Graph, q: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    if not q:
        raise ValueError("a search needs a character at least")
    return g.kps.where(contains(q, "name", "aliases")).select(*KP_COLUMNS).orderBy("chapter_id", "section", "kp_id").limit(limit)


def editor_search(g: Graph, q: str) -> DataFrame:
    return g.kps.where(contains(q, "name", "kp_id")).select(*KP_COLUMNS)


def lookup(g: Graph, kp_id: str) -> DataFrame:
    """No row if there is none; the caller raises."""
    return g.kps.where(F.col("kp_id") == kp_id).select(*KP_COLUMNS)


def explain_lookup(g: Graph, kp_id: str) -> DataFrame:
    return g.kps.where(F.col("kp_id") == kp_id).select("name", F.to_json(F.struct(*g.kps.columns)).alias("properties"))


def by_label(rows: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """rows in the order of their labels as Chinese sorts them, by sound; equal labels by key."""
    return rows.orderBy(F.collate(F.col(label), CHINESE), key)


def out_neighbors(g: Graph, type_: str, kp_id: str | None = None) -> DataFrame:
    """The far ends of a node's (or every node's) edges of a type, one row an edge."""
    e = g.of_type(type_) if kp_id is None else g.of_type(type_).where(F.col("src") == kp_id)
    return e.select("src", F.col("dst").alias("kp_id")).join(g.kps.select(*KP_COLUMNS), "kp_id")


def in_neighbors(g: Graph, type_: str, kp_id: str | None = None) -> DataFrame:
    e = g.of_type(type_) if kp_id is None else g.of_type(type_).where(F.col("dst") == kp_id)
    return e.select("dst", F.col("src").alias("kp_id")).join(g.kps.select(*KP_COLUMNS), "kp_id")


def undirected_neighbors(g: Graph, kp_id: str, type_: str = "RELATED", limit: int | None = RELATED_LIMIT) -> DataFrame:
    """One row an edge in either direction, a loop once; A to B and B to A list the neighbour twice."""
    e = g.of_type(type_)
    far = e.where(F.col("src") == kp_id).select(F.col("dst").alias("kp_id")).unionAll(
        e.where((F.col("dst") == kp_id) & (F.col("src") != kp_id)).select(F.col("src").alias("kp_id")))
    out = far.join(g.kps.select(*KP_COLUMNS), "kp_id")
    return out if limit is None else out.orderBy("kp_id").limit(limit)


def export_nodes(g: Graph, limit: int = NODE_LIMIT) -> DataFrame:
    return g.nodes().orderBy("id").limit(limit)


def export_edges(g: Graph, limit: int = EDGE_LIMIT) -> DataFrame:
    """Edges with both ends among the exported labels; the limit is its own, so an edge may lead out of export_nodes."""
    ids = g.nodes().select("id")
    return (g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
            .select(edge_id().alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("label"), "type")
            .orderBy("source", "target", "type").limit(limit))


def edge_id() -> Column:
    """A stable name for an edge: its ends and its type."""
    return F.concat_ws("|", "src", "type", "dst")


def subgraph_by_chapter(g: Graph, chapter_id: str) -> tuple[DataFrame, DataFrame]:
    """Knowledge points and examples of a chapter (by property), and the edges between them."""
    nodes = g.kps.where(F.col("chapter_id") == chapter_id).select(F.col("kp_id").alias("id"), F.lit("knowledge_point").alias("type")).unionAll(
        g.examples.where(F.col("chapter_id") == chapter_id).select(F.col("example_id").alias("id"), F.lit("example").alias("type")))
    return nodes, induced(g.edges, nodes.select("id"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def top_chapters(g: Graph, limit: int = TOP_CHAPTERS) -> DataFrame:
    return list_chapters(g).limit(limit)


def type_counts(g: Graph) -> DataFrame:
    return g.nodes().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def kp_card(g: Graph, delimiter: str = ",", shown: int = 3) -> DataFrame:
    """What a detail panel shows: the source with its pages, and an introduction with the first aliases."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    book = F.coalesce(blank("source_book"), blank("source"), F.lit("未记录来源"))
    page = F.coalesce(blank("source_pages"), F.when(F.coalesce("source_page", F.lit(0)) != 0, F.concat(F.lit("第 "), F.col("source_page").cast("string"), F.lit(" 页"))))
    source = F.when(page.isNotNull(), F.concat(book, F.lit(" · "), page)).otherwise(book)
    names = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), delimiter), lambda x: F.trim(x)), lambda x: x != "")
    known = blank("source_book").isNotNull() | blank("source").isNotNull() | page.isNotNull()
    intro = F.concat_ws("；", F.when(blank("section").isNotNull(), F.concat(F.lit("位于 "), "section")),
                        F.when(blank("aliases").isNotNull(), F.concat(F.lit("别名："), F.array_join(F.slice(names, 1, shown), "、"))),
                        F.when(known, F.concat(F.lit("来源："), source)))
    none = F.lit("暂无简介，后续可以在导入数据时补充知识点说明。")
    return g.kps.select("kp_id", "name", source.alias("source_text"), F.when(intro == "", none).otherwise(intro).alias("intro"))


def chapter_panels(g: Graph, kp_id: str) -> DataFrame:
    """(panel, kp_id, name): a node's prerequisites, successors and related nodes, those of its own chapter only. The limit of
    related ones comes first, so their panel may be short."""
    own = g.kps.where(F.col("kp_id") == kp_id).select(F.col("chapter_id").alias("_own"))
    panel = lambda df, name: df.select(F.lit(name).alias("panel"), "kp_id", "name", "chapter_id")
    every = panel(in_neighbors(g, "PREREQUISITE", kp_id), "prerequisites").unionAll(panel(out_neighbors(g, "PREREQUISITE", kp_id), "successors")).unionAll(panel(undirected_neighbors(g, kp_id), "related"))
    return every.join(own, every["chapter_id"] == own["_own"], "left_semi").select("panel", "kp_id", "name")
