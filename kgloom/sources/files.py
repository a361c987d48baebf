"""Readers and writers. Every CSV column is text: inferred types would turn section 1.10 into 1.1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import model


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def csv(spark: SparkSession, path: str, columns: list[str], must_exist: bool = False) -> DataFrame:
    """A CSV with a header; no file gives no rows, null gives empty text. A byte order mark is dropped by the reader."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    if not _exists(spark, path) and not must_exist:
        return spark.createDataFrame([], schema)
    found = spark.read.option("header", True).option("multiLine", True).csv(path)
    named = {c.lstrip("﻿").strip(): c for c in found.columns}
    return found.select(*[F.coalesce(F.col(f"`{named[c]}`"), F.lit("")).alias(c) if c in named else F.lit("").alias(c) for c in columns])


def relations_csv(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Optional relation rows; the comment mark cuts the rest of any line. Rows without both ends go."""
    columns = ["source_kp_id", "target_kp_id", "relation_type", "description"]
    if not _exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    cut = spark.read.text(path).select(F.regexp_replace("value", f"{comment}.*", "").alias("value")).where("trim(value) <> ''")
    head = [c.strip() for c in cut.first()["value"].split(",")]
    rows = cut.where(F.trim("value") != ",".join(head)).select(F.from_csv("value", F.lit(", ".join(f"{c} string" for c in head))).alias("r")).select("r.*")
    named = rows.select(*[(F.coalesce(F.col(c), F.lit("")) if c in head else F.lit("")).alias(c) for c in columns])
    return named.where("source_kp_id <> '' and target_kp_id <> ''")


def naive_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines split at commas without quoting: short rows go, long ones are cut."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("p"))
    head = raw.orderBy("i").first()["p"]
    return raw.where((F.size("p") >= len(head)) & (F.col("p") != F.array(*[F.lit(h) for h in head]))).select(*[F.get("p", F.lit(k)).alias(h) for k, h in enumerate(head)])


def jsonl(spark: SparkSession, path: str, schema: StructType | str, must_exist: bool = False) -> DataFrame:
    """JSON lines; a bad line raises, blank ones are skipped, no file gives no rows unless it must be there."""
    if not _exists(spark, path) and not must_exist:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_order(df: DataFrame) -> DataFrame:
    """df with `ord`, the order of its files' lines; gaps don't matter."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def sections(spark: SparkSession, path: str, chapter: str | None = None, fold_case: bool = False) -> DataFrame:
    df = jsonl(spark, path, model.SECTION, True)
    return df if chapter is None else df.where(F.col("chapter_id") == (chapter.upper() if fold_case else chapter))


def texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def chapter_texts(spark: SparkSession, folder: str, chapters: dict[str, str]) -> DataFrame:
    """(chapter_id, text) of the chapters' files that exist. chapters: file name to chapter."""
    if not _exists(spark, f"{folder}/*"):
        return spark.createDataFrame([], "chapter_id string, text string")
    names = F.create_map(*[F.lit(x) for pair in chapters.items() for x in pair])
    return texts(spark, f"{folder}/*").select(F.element_at(names, F.url_decode(F.element_at(F.split("path", "/"), -1))).alias("chapter_id"), "text").where("chapter_id is not null")


def page_window(pages: DataFrame, start: int | None = None, end: int | None = None, most: int = 40) -> DataFrame:
    """A chapter's pages, clamped to those that exist, else the first `most`. pages: job_id, page, text."""
    if start is None or end is None:
        return pages.where(F.col("page") <= most)
    last = pages.groupBy("job_id").agg(F.max("page").alias("_last"))
    inside = F.col("page").between(F.greatest(F.lit(1), F.least(F.lit(start), "_last")), F.least(F.lit(max(start, end)), "_last"))
    return pages.join(last, "job_id").where(inside).select(*pages.columns)


def upload_kind(name):
    """What an uploaded file holds, by its name: chapter before kp or knowledge before edge, relation or contains."""
    low = F.lower(name)
    has = lambda *w: F.regexp_like(low, F.lit("|".join(w)))
    return F.when(has("chapter"), "chapter").when(has("kp", "knowledge"), "kp").when(has("edge", "relation", "contains"), "relation")


def uploaded_relations(df: DataFrame) -> DataFrame:
    """Relation rows whose columns go by either of two names. Rows without an end stay, for review."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))
    return df.select(pick("source", "source_kp_id").alias("source"), pick("target", "target_kp_id").alias("target"), F.coalesce(pick("relation_type", "type"), F.lit("RELATED")).alias("relation_type"),
                     F.coalesce(pick("description"), F.lit("")).alias("description"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_turtle(lines: DataFrame, path: str, base: str) -> None:
    """Lines (part, key, line) in order behind the prefixes."""
    head = lines.sparkSession.createDataFrame([(0, "0", f"@prefix ckg: <{base}> ."), (0, "1", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .")], "part int, key string, line string")
    lines.unionByName(head).orderBy("part", "key", "line").select("line").write.mode("overwrite").text(path)
