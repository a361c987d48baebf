"""Upserts, deletes and constraints over node and edge snapshots: a snapshot in, a snapshot out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_TYPES


def last_per_key(rows: DataFrame, key: list[str], ord_: str = "ord") -> DataFrame:
    rest = [c for c in rows.columns if c not in (*key, ord_)]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), ord_).alias("_l")).select(*key, "_l.*") if rest else rows.select(*key).distinct()


def merge_nodes(base: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with rows (ord) merged by key: listed columns overwritten (null removes a value), others kept, new keys created.
    Of several rows a key the last counts."""
    new = last_per_key(rows.select(key, *columns, "ord"), [key]).select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    both = base.join(new, key, "full")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def merge_edges(base: DataFrame, rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """base with rows (ord) merged; an edge is its ends and type (or the key given), the last row's properties count."""
    key = key or ["src", "dst", "type"]
    rest = [c for c in base.columns if c not in key]
    new = last_per_key(rows.select(*key, *rest, "ord"), key)
    return base.join(new.select(*key), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def link(rows: DataFrame, sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ends both exist, the rest): sources and targets are (id). Unmatched rows vanish from a load; here they can be seen."""
    known = lambda df, end: df.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")).distinct()
    seen = rows.join(known(sources, "src"), "src", "left").join(known(targets, "dst"), "dst", "left")
    both = F.coalesce(F.col("_src") & F.col("_dst"), F.lit(False))
    return seen.where(both).select(*rows.columns), seen.where(~both).select(*rows.columns)


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of gone (id) and every edge at them."""
    ids = gone.select("id").distinct()
    left = nodes.join(ids.withColumnRenamed("id", key), key, "left_anti")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left.select(*nodes.columns), e.select(*edges.columns)


def merge_labelled(base: DataFrame, rows: DataFrame, key: str, columns: list[str], labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(base merged, violations): a merge on labels and key together. base has `labels`, an array. A row whose key is there with all the
    labels updates it, one whose key is new creates it, and one whose key is there without all of them would create a second
    node of the key: it is a violation (key) and changes nothing."""
    there = base.select(F.col(key), (F.size(F.array_except(F.array(*[F.lit(x) for x in labels]), "labels")) == 0).alias("_fits"))
    seen = rows.join(there, key, "left")
    ok = seen.where(F.coalesce("_fits", F.lit(True))).drop("_fits")
    merged = merge_nodes(base, ok, key, columns)
    return merged.withColumn("labels", F.coalesce("labels", F.array(*[F.lit(x) for x in labels]))), seen.where(~F.col("_fits")).select(key).distinct()


def merge_fused(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Fused edges: predicate, object and source are part of the key, the section isn't, so rows of several sections are one, the last."""
    return merge_edges(base, rows, ["src", "dst", "type", "predicate", "object_id", "source"])


def upsert_other(base: DataFrame, rows: DataFrame, key: str, columns: list[str], taken: list[str]) -> DataFrame:
    """base merged with rows (entity_type, ord) whose type has no table of its own."""
    return merge_nodes(base, rows.where(~F.col("entity_type").isin(*taken)), key, columns)


def of_types(rows: DataFrame, types: list[str]) -> DataFrame:
    """Relation rows of the types that a load takes; rows of other types are left out, and a load of an unknown type is an error."""
    if odd := set(types) - set(EDGE_TYPES):
        raise ValueError(f"no such relation types: {sorted(odd)}")
    return rows.where(F.col("type").isin(*types))


def violations(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) that a unique constraint forbids; null keys aren't constrained."""
    some = df
    for k in key:
        some = some.where(F.col(k).isNotNull())
    return some.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    if bad := violations(df, key).take(5):
        raise ValueError(f"not unique on {key}: {bad}")
    return df


def assert_not_null(df: DataFrame, column: str) -> DataFrame:
    if df.where(F.col(column).isNull()).take(1):
        raise ValueError(f"{column} has nulls")
    return df
