"""Uploaded files: CSV by what their names say, JSON lists by the keys of their items. A file that can't be read is a row of errors and fails nothing else.

Files come as (file, content), as the binary file source gives them; one file is one row. The results are items (file, pos, kind, data),
data a map of texts, and errors (file, error). Of a JSON list, what stands before the first item that has no keys (a number, a boolean or null) counts;
the file is an error as well. Other JSON than lists, and files of other names, hold nothing.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import upload_kind

SOURCE = "文件上传"


def binary(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, content) of whole files."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"), "content")


def _csv(files: DataFrame) -> DataFrame:
    """(file, kind, pos, data, error) of the CSV files: each by its own header, quoted fields across lines, a byte order mark dropped."""

    def parse(batches: Iterator) -> Iterator:
        import csv

        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            for file, kind, content in zip(*[batch.column(c).to_pylist() for c in ("file", "kind", "content")], strict=True):
                rows = []
                try:
                    for i, row in enumerate(csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline=""))):
                        rows.append((file, kind, i, [(k, v) for k, v in row.items() if k is not None and v is not None], None))
                except (UnicodeDecodeError, csv.Error) as e:
                    rows = [(file, kind, None, None, f"{type(e).__name__}: {e}")]  # nothing of a file that breaks off
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["file", "kind", "pos", "data", "error"])

    return files.select("file", "kind", "content").mapInArrow(parse, "file string, kind string, pos int, data map<string,string>, error string")


def _json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    text = F.ltrim(F.try_validate_utf8(F.col("content").cast("string")), F.lit("﻿"))
    v = files.select("file", text.alias("text")).withColumn("v", F.try_parse_json("text"))
    item = v.select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "item")).withColumn("is", F.schema_of_variant("item"))
    has = lambda key: F.col("is").startswith("OBJECT") & F.try_variant_get("item", f"$.{key}", "variant").isNotNull()
    keyless = ~F.col("is").rlike("^(OBJECT|ARRAY|STRING)")
    broken = item.where(keyless).groupBy("file").agg(F.min("pos").alias("_end"))
    kind = F.when(has("kp_id"), "kp").when(has("chapter_id"), "chapter")
    found = item.join(broken, "file", "left").where(F.coalesce(F.col("pos") < F.col("_end"), F.lit(True))).withColumn("kind", kind).where("kind is not null")
    data = F.from_json(F.to_json("item"), "map<string,string>")
    errors = v.where("v is null").select("file", F.when(F.col("text").isNull(), "not UTF-8").otherwise("not JSON").alias("error")).unionAll(
        broken.select("file", F.concat(F.lit("item "), F.col("_end").cast("string"), F.lit(" has no keys"))))
    return found.select("file", "pos", "kind", data.alias("data"), F.lit(True).alias("listed")), errors


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items (file, pos, kind, data, listed), errors (file, error)) of files (file, content); listed items are from JSON."""
    name = F.element_at(F.split("file", "/"), -1)
    rows = _csv(files.where(F.endswith(name, F.lit(".csv"))).withColumn("kind", upload_kind(name)).where("kind is not null"))
    items, errors = _json(files.where(F.endswith(name, F.lit(".json"))))
    return (rows.where("error is null").select("file", "pos", "kind", "data", F.lit(False).alias("listed")).unionAll(items), rows.where("error is not null").select("file", "error").unionAll(errors))


def kps(items: DataFrame, existing: DataFrame) -> DataFrame:
    """(file, pos, data): the nodes, with their source and status. A node of a CSV that exists (kp_id) is an update; those of JSON are new."""
    k = items.where("kind = 'kp'").withColumn("_id", F.coalesce(F.element_at("data", "kp_id"), F.lit("")))
    k = k.join(existing.select(F.col("kp_id").alias("_id"), F.lit(True).alias("_there")).distinct(), "_id", "left")
    plain = F.map_from_arrays(F.array(*[F.lit(c) for c in ("kp_id", "name", "chapter_id", "section", "aliases", "source")]), F.array(
        *[F.coalesce(F.element_at("data", c), F.lit("")) for c in ("kp_id", "name", "chapter_id")], F.element_at("data", "section"), F.element_at("data", "aliases"), F.coalesce(F.element_at("data", "source"), F.lit(SOURCE))))
    status = F.when(F.col("_there") & ~F.col("listed"), "update").otherwise("new")
    data = F.when(F.col("listed"), F.map_filter("data", lambda k, v: k != "status")).otherwise(plain)
    return k.select("file", "pos", F.map_concat(data, F.create_map(F.lit("status"), status)).alias("data"))


def relations(items: DataFrame) -> DataFrame:
    """(file, pos, source, target, relation_type, description): each end by either of two names; rows without an end stay, for review."""
    d = lambda *names: F.coalesce(*[F.nullif(F.element_at("data", n), F.lit("")) for n in names], F.lit(""))
    return items.where("kind = 'relation'").select("file", "pos", d("source", "source_kp_id").alias("source"), d("target", "target_kp_id").alias("target"),
                                                   F.coalesce(F.nullif(d("relation_type", "type"), F.lit("")), F.lit("RELATED")).alias("relation_type"), d("description").alias("description"))


def counts(items: DataFrame) -> DataFrame:
    """(kind, n) of the items of each kind."""
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
