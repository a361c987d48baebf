"""A deterministic property graph over the relational tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import Graph


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _key(prefix: str, column, width: int):
    """The prefix and a number of `width` digits or, where it has more, of all of its own."""
    text = column.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts (a, b) that follow each other in an order, as often as they do."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return l.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("b is not null and a <> b")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return follows(spark, sf_dir).distinct()


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph. PREREQUISITE edges are the pairs in ascending order, so they have no cycle."""
    chapters = read(spark, sf_dir, "nation").select(_key("CH", F.col("n_nationkey"), 2).alias("chapter_id"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("bigint").alias("order"))
    kps = read(spark, sf_dir, "part").select(
        _key("KP", F.col("p_partkey"), 6).alias("kp_id"), F.col("p_name").alias("name"), _key("CH", F.col("p_partkey") % 25, 2).alias("chapter_id"), F.col("p_brand").alias("section"),
        F.col("p_type").alias("aliases"), F.lit("seed").alias("source"), F.lit("book").alias("source_book"), F.col("p_size").alias("source_page"), F.lit("").alias("source_pages"))
    examples = read(spark, sf_dir, "supplier").select(_key("EX", F.col("s_suppkey"), 6).alias("example_id"), F.col("s_name").alias("name"), _key("CH", F.col("s_suppkey") % 25, 2).alias("chapter_id"))
    adjacent = pairs(spark, sf_dir)
    edge = lambda df, s, d, t: df.select(s.alias("src"), d.alias("dst"), F.lit(t).alias("type"))
    edges = edge(kps, F.col("chapter_id"), F.col("kp_id"), "CONTAINS").unionAll(
        edge(adjacent, _key("KP", F.col("a"), 6), _key("KP", F.col("b"), 6), "RELATED")).unionAll(
        edge(adjacent.where("a < b"), _key("KP", F.col("a"), 6), _key("KP", F.col("b"), 6), "PREREQUISITE")).unionAll(
        edge(read(spark, sf_dir, "supplier"), _key("EX", F.col("s_suppkey"), 6), _key("KP", F.col("s_suppkey"), 6), "EXAMPLE_OF"))
    return Graph(chapters, kps, examples, edges)


SQL = """
chapters AS (SELECT 'CH' || lpad(n_nationkey::VARCHAR, greatest(2, length(n_nationkey::VARCHAR))::INTEGER, '0') AS chapter_id, n_name AS title, n_nationkey::BIGINT AS "order" FROM nation),
kps AS (SELECT 'KP' || lpad(p_partkey::VARCHAR, greatest(6, length(p_partkey::VARCHAR))::INTEGER, '0') AS kp_id, p_name AS name, 'CH' || lpad((p_partkey % 25)::VARCHAR, greatest(2, length((p_partkey % 25)::VARCHAR))::INTEGER, '0') AS chapter_id, p_brand AS section,
  p_type AS aliases, 'seed' AS source, 'book' AS source_book, p_size AS source_page, '' AS source_pages FROM part),
examples AS (SELECT 'EX' || lpad(s_suppkey::VARCHAR, greatest(6, length(s_suppkey::VARCHAR))::INTEGER, '0') AS example_id, s_name AS name, 'CH' || lpad((s_suppkey % 25)::VARCHAR, greatest(2, length((s_suppkey % 25)::VARCHAR))::INTEGER, '0') AS chapter_id FROM supplier),
follows AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
pairs AS (SELECT DISTINCT 'KP' || lpad(a::VARCHAR, greatest(6, length(a::VARCHAR))::INTEGER, '0') AS src, 'KP' || lpad(b::VARCHAR, greatest(6, length(b::VARCHAR))::INTEGER, '0') AS dst, a, b FROM follows WHERE b IS NOT NULL AND a <> b),
dag AS (SELECT src, dst FROM pairs WHERE a < b),
edges AS (SELECT chapter_id AS src, kp_id AS dst, 'CONTAINS' AS type FROM kps UNION ALL SELECT src, dst, 'RELATED' FROM pairs
  UNION ALL SELECT src, dst, 'PREREQUISITE' FROM dag UNION ALL SELECT 'EX' || lpad(s_suppkey::VARCHAR, greatest(6, length(s_suppkey::VARCHAR))::INTEGER, '0'), 'KP' || lpad(s_suppkey::VARCHAR, greatest(6, length(s_suppkey::VARCHAR))::INTEGER, '0'), 'EXAMPLE_OF' FROM supplier)
"""
