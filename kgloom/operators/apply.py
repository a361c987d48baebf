"""Approved changes applied to a graph's snapshots, in order, without a loop over them.

What a key's events leave depends on few of them: its last deletion, the first addition behind that, and for each column the
last value set from there on. Each is an aggregate with partial sums, so no task gathers all events of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KP_COLUMNS = ["name", "chapter_id", "section", "aliases", "source"]
CHAPTER_COLUMNS = ["title", "order"]
BASE = -1


def _alive(events: DataFrame) -> DataFrame:
    """(key, since): keys that are there at the end, and the event that made them. events: key, seq, action."""
    gone = events.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("action") == "delete", F.col("seq"))), F.lit(BASE - 1)).alias("gone"))
    return events.where("action = 'add'").join(gone, "key").where("seq > gone").groupBy("key").agg(F.min("seq").alias("since"))


def _nodes(events: DataFrame, alive: DataFrame, columns: list[str]) -> DataFrame:
    """(key, columns): an addition sets all columns, an update those that it has."""
    e = events.join(alive, "key").where("seq >= since and action <> 'delete'")
    last = lambda c: F.max(F.when((F.col("action") == "add") | F.col(f"values.{c}").isNotNull(), F.struct("seq", F.col(f"values.{c}").alias("v")))).alias(c)
    return e.groupBy("key").agg(*[last(c) for c in columns]).select("key", *[F.col(f"`{c}`.v").alias(c) for c in columns])


def _edges(adds: DataFrame, alive: DataFrame) -> DataFrame:
    """Edges (src, dst, type, description) added since both ends are there; the last addition describes."""
    ends = alive.select(F.col("key").alias("src"), F.col("since").alias("_a"))
    others = alive.select(F.col("key").alias("dst"), F.col("since").alias("_b"))
    e = adds.join(ends, "src").join(others, "dst").where("seq >= _a and seq >= _b")
    return e.groupBy("src", "dst", "type").agg(F.max_by("description", "seq").alias("description"))


def apply_reviewed(chapters: DataFrame, kps: DataFrame, edges: DataFrame, items: DataFrame, mode: str = "append") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chapters, kps, edges, failed) after approved items (seq, id, type, action, data map<string,string>).

    chapter: add and update both write title and order; kp: add writes KP_COLUMNS and the edge from its chapter, if that is there,
    update writes what data has of them, where the node is there; delete takes a node with its edges; relation: add writes an edge
    between nodes that are there. An added kp whose data lacks a column fails, and changes nothing. Other types and actions
    change nothing. Mode replace starts from an empty graph of chapters and kps: edges at them go, edges between other nodes stay.
    chapters: chapter_id, title, order; kps: kp_id, KP_COLUMNS; edges: src, dst, type, description.
    """
    d = F.col("data")
    lacking = F.filter(F.array(*[F.lit(c) for c in ["kp_id", *KP_COLUMNS]]), lambda c: ~F.array_contains(F.map_keys(d), c))
    bad = (F.col("type") == "kp") & (F.col("action") == "add") & (F.size(lacking) > 0)
    failed = items.where(bad).select("id", F.concat(F.lit("missing "), F.array_join(lacking, ", ")).alias("error"))
    done = items.where(~bad)
    values = lambda columns, of: F.struct(*[of(c).alias(c) for c in columns])
    given = lambda columns: values(columns, lambda c: F.element_at(d, c) if c != "order" else F.element_at(d, c).try_cast("bigint"))
    start = 0 if mode == "replace" else 1
    chapter_events = chapters.where(F.lit(start) == 1).select(F.col("chapter_id").alias("key"), F.lit(BASE).cast("bigint").alias("seq"), F.lit("add").alias("action"), values(CHAPTER_COLUMNS, F.col).alias("values")).unionAll(
        done.where("type = 'chapter' and action in ('add', 'update', 'delete')").select(F.coalesce(F.element_at(d, "chapter_id"), F.lit("")), "seq", F.when(F.col("action") == "update", "add").otherwise(F.col("action")), given(CHAPTER_COLUMNS)))
    kp_events = kps.where(F.lit(start) == 1).select(F.col("kp_id").alias("key"), F.lit(BASE).cast("bigint").alias("seq"), F.lit("add").alias("action"), values(KP_COLUMNS, F.col).alias("values")).unionAll(
        done.where("type = 'kp' and action in ('add', 'update', 'delete')").where(F.element_at(d, "kp_id").isNotNull()).select(F.element_at(d, "kp_id"), "seq", "action", given(KP_COLUMNS)))
    chapters_left, kps_left = _alive(chapter_events), _alive(kp_events)
    # other nodes, at the ends of edges only, are there from the start
    known = chapters.select(F.col("chapter_id").alias("key")).union(kps.select(F.col("kp_id").alias("key")))
    rest = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct().join(known, "key", "left_anti").select("key", F.lit(BASE).cast("bigint").alias("since"))
    contains = done.where("type = 'kp' and action = 'add'").select("seq", F.element_at(d, "chapter_id").alias("src"), F.element_at(d, "kp_id").alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(None).cast("string").alias("description"))
    filled = lambda *names: F.coalesce(*[F.nullif(F.element_at(d, n), F.lit("")) for n in names])
    related = done.where("type = 'relation' and action = 'add'").select("seq", filled("source", "source_kp_id").alias("src"), filled("target", "target_kp_id").alias("dst"),
                                                                       F.coalesce(filled("relation_type", "type"), F.lit("RELATED")).alias("type"), F.coalesce(F.element_at(d, "description"), F.lit("")).alias("description"))
    base = edges.select(F.lit(BASE).cast("bigint").alias("seq"), "src", "dst", "type", "description")
    between = _edges(base, chapters_left.union(kps_left).union(rest))
    # an edge that is there and written again: a relation's description counts, containment leaves it
    both = between.select("*", F.lit(0).alias("_n")).unionAll(_edges(contains, chapters_left.union(kps_left)).select("*", F.lit(-1))).unionAll(_edges(related, kps_left).select("*", F.lit(1)))
    out = both.groupBy("src", "dst", "type").agg(F.max_by("description", "_n").alias("description"))
    c = _nodes(chapter_events, chapters_left, CHAPTER_COLUMNS).withColumnRenamed("key", "chapter_id")
    return c, _nodes(kp_events, kps_left, KP_COLUMNS).withColumnRenamed("key", "kp_id"), out, failed


def kp_edits(requests: DataFrame) -> DataFrame:
    """Review items (type, action, data, source) of edits (action, kp_id, data map): values that are null aren't part of an update,
    a deletion has the id only."""
    given = F.coalesce("data", F.create_map().cast("map<string,string>"))
    id_ = F.create_map(F.lit("kp_id"), F.col("kp_id"))
    update = F.map_concat(F.map_filter(given, lambda k, v: v.isNotNull() & (k != "kp_id")), id_)
    data = F.when(F.col("action") == "delete", id_).when(F.col("action") == "update", update).otherwise(F.map_concat(F.map_filter(given, lambda k, v: k != "kp_id"), id_))
    source = F.when(F.col("action") == "add", "手动新增").when(F.col("action") == "update", "手动编辑").otherwise("手动删除")
    return requests.select("ord", F.lit("kp").alias("type"), "action", data.alias("data"), source.alias("source"))


def confirm_import(kps: DataFrame, relations: DataFrame) -> DataFrame:
    """Review items of an upload's kps (ord, data map), updates where their status says so, then its relations. Chapters aren't queued."""
    k = kps.select(F.struct(F.lit(0).alias("part"), "ord").alias("ord"), F.lit("kp").alias("type"), F.when(F.element_at("data", "status") == "update", "update").otherwise("add").alias("action"), "data")
    r = relations.select(F.struct(F.lit(1).alias("part"), "ord").alias("ord"), F.lit("relation").alias("type"), F.lit("add").alias("action"), "data")
    return k.unionAll(r).withColumn("source", F.lit("文件上传"))
