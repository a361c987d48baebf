"""Scores, reasons and gates for candidate nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.scalars import any_match, candidate_type, category, has_any, norm_name, or_empty, py_strip, truthy

PASS_SCORE = 65


def with_similarity(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """rows with `near`, the greatest character Jaccard of the name and any seed name; names repeat, so each is compared once."""
    from .dedup import name_overlaps

    names = rows.select(norm_name(F.col("name")).alias("a")).distinct()
    s = seeds.select(norm_name(F.col("name")).alias("b")).where("b <> ''").distinct()
    best = name_overlaps(names, s).groupBy(F.col("a").alias("_n")).agg(F.max("similarity").alias("near"))
    return rows.withColumn("_n", norm_name(F.col("name"))).join(best, "_n", "left").withColumn("near", F.coalesce("near", F.lit(0.0))).drop("_n")


def _parts() -> dict[str, Column]:
    name = norm_name(F.col("name"))
    kind = py_strip(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("other")))
    description = py_strip(or_empty(F.col("description")))
    return {"name": name, "kind": kind, "summary": py_strip(or_empty(F.col("summary"))), "description": description, "code": py_strip(or_empty(F.col("code_example"))),
            "generic": any_match(name, t.GENERIC_NAMES), "anchor": has_any(F.lower(name), t.ANCHORS) | has_any(description, t.ANCHORS),
            "method": F.coalesce(F.col("candidate_type") == "MethodPattern", F.lit(False)), "duplicate": truthy(F.col("duplicate_of"))}


def _rules(p: dict[str, Column]) -> list[tuple[Column, int, Column]]:
    """(condition, points, reason) in the order of reasons; the anchor bonus has none."""
    return [
        (~p["kind"].isin(*t.CATEGORY_NAMES), -25, F.concat(F.lit("类别异常: "), p["kind"])), (p["generic"], -35, F.lit("命中过泛词")),
        (F.length(p["summary"]) < 12, -10, F.lit("summary过短")), (F.length(p["description"]) < 40, -20, F.lit("description过短")),
        (p["code"] == "", -8, F.lit("缺少代码示例")), (p["kind"] == "other", -20, F.lit("category=other")),
        (p["method"], -25, F.lit("candidate_type=MethodPattern")), (p["duplicate"], -20, F.concat(F.lit("duplicate_of="), or_empty(F.col("duplicate_of")))),
        (F.col("near") >= 0.85, -25, F.concat(F.lit("疑似与seed重复("), F.format_string("%.2f", "near"), F.lit(")"))),
    ]


def score(rows: DataFrame) -> DataFrame:
    """rows (with `near`) and quality_score, quality_reasons, quality_hard_reject."""
    p = _parts()
    rules = _rules(p)
    total = F.lit(100) + F.when(p["anchor"], 8).otherwise(0)
    for condition, points, _ in rules:
        total = total + F.when(condition, points).otherwise(0)
    reasons = F.filter(F.array(*[F.when(c, r) for c, _, r in rules]), lambda x: x.isNotNull())
    empty = p["name"] == ""
    reject = (F.when(empty, "empty_name").when(F.length(p["description"]) < 20, "description_too_short").when(p["generic"], "generic_name")
              .when(p["duplicate"], "duplicate_of_seed").when(p["method"], "method_pattern"))
    return rows.select("*", F.when(empty, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).alias("quality_score"),
                       F.when(empty, F.array(F.lit("名称为空"))).otherwise(reasons).alias("quality_reasons"), reject.alias("quality_hard_reject"))


def passes(least: int = PASS_SCORE) -> Column:
    return F.col("quality_hard_reject").isNull() & (F.col("quality_score") >= least)


def gate(scored: DataFrame, least: int = PASS_SCORE) -> tuple[DataFrame, DataFrame]:
    return scored.where(passes(least)), scored.where(~passes(least))


def postprocess(rows: DataFrame) -> DataFrame:
    """Candidates normalized, classified, filtered and deduped. rows: ord, section_key, name, category, description, duplicate_of."""
    from .dedup import greedy

    r = rows.withColumn("name", norm_name(F.col("name"))).withColumn("category", category(F.col("category")))
    r = r.withColumn("candidate_type", candidate_type(F.col("name"), F.col("category")))
    ok = truthy(F.col("name")) & ~any_match(F.col("name"), t.GENERIC_NAMES) & (F.length(or_empty(F.col("description"))) >= 30) & ~truthy(F.col("duplicate_of")) & (F.col("candidate_type") == "KnowledgePoint")
    return greedy(r.where(ok))
