"""A graph table that lasts: bucketed files under a manifest, merged by rewriting the buckets that rows touch.

A table is a folder. Its data lie in folders of their own name, one a write, with a file folder for each bucket of the key's hash; a manifest
`manifest-N.json` names the folder of every bucket in version N. A merge reads the touched buckets, writes them anew and, as its
last step, renames the next manifest into place. Until then readers see the version before, also after a writer is lost, whose files
no manifest names. Two writers on one version both want the same next manifest: the rename of the second fails, and it raises.
A key is hashed and occurs once in a table, so buckets are even; their number is a parameter of the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


@dataclass
class Manifest:
    version: int
    key: list[str]
    buckets: int
    schema: str
    folders: dict[str, str]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def latest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a version; null if there is none."""
    p, fs = _fs(spark, f"{path}/manifest-*.json" if version is None else f"{path}/manifest-{version:012d}.json")
    found = sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))
    if not found:
        return None
    text = spark.read.text(found[-1], wholetext=True).first()["value"]
    return Manifest(**json.loads(text))


def _commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    jvm, (end, fs) = spark._jvm, _fs(spark, f"{path}/manifest-{manifest.version:012d}.json")
    draft, _ = _fs(spark, f"{path}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(asdict(manifest)).encode())
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE  # doesn't replace a file that is there
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(draft, end, options)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(end):
            raise Conflict(f"version {manifest.version} of {path} is there already") from e
        raise


def _bucket(key: list[str], n: int):
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _write(df: DataFrame, path: str, key: list[str], buckets: int) -> dict[str, str]:
    """Writes df by buckets into a new folder; which bucket lies where. Empty buckets have no folder."""
    folder = f"data-{uuid.uuid4().hex}"
    df.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    p, fs = _fs(df.sparkSession, f"{path}/{folder}/_bucket=*")
    return {s.getPath().getName().removeprefix("_bucket="): f"{folder}/{s.getPath().getName()}" for s in (fs.globStatus(p) or [])}


def create(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> Manifest:
    """A new table of df's rows, whose keys are unique, as version 0."""
    first = Manifest(0, key, buckets, df.schema.json(), _write(df, path, key, buckets))
    _commit(df.sparkSession, path, first)
    return first


def _rows(spark: SparkSession, path: str, m: Manifest, buckets: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(m.schema))
    some = [f"{path}/{f}" for b, f in sorted(m.folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*some) if some else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    m = latest(spark, path, version)
    if m is None:
        raise FileNotFoundError(f"no table at {path}" + ("" if version is None else f" has version {version}"))
    return _rows(spark, path, m)


def update(path: str, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Manifest:
    """The next version: change(base, rows) takes the place of the buckets that rows touch by the table's key."""
    spark = rows.sparkSession
    m = latest(spark, path)
    if m is None:
        raise FileNotFoundError(f"no table at {path}")
    touched = [str(r["b"]) for r in rows.select(_bucket(m.key, m.buckets).alias("b")).distinct().collect()]  # the table's buckets at most
    base = _rows(spark, path, m, touched)
    new = _write(change(base, rows).select(*base.columns), path, m.key, m.buckets) if touched else {}
    after = Manifest(m.version + 1, m.key, m.buckets, m.schema, {b: f for b, f in m.folders.items() if b not in touched} | new)
    _commit(spark, path, after)
    return after


def merge_nodes(path: str, rows: DataFrame, columns: list[str]) -> Manifest:
    """store.merge_nodes of rows (key, columns, ord) into the table, whose key is one column."""
    key = latest(rows.sparkSession, path).key[0]
    return update(path, rows, lambda base, new: store.merge_nodes(base, new, key, columns))


def merge_edges(path: str, rows: DataFrame) -> Manifest:
    """store.merge_edges of rows (key, properties, ord) into the table."""
    key = latest(rows.sparkSession, path).key
    return update(path, rows, lambda base, new: store.merge_edges(base, new, key))


def delete(path: str, gone: DataFrame) -> Manifest:
    """The rows whose key is in gone go."""
    key = latest(gone.sparkSession, path).key
    return update(path, gone, lambda base, g: base.join(g.select(*key).distinct(), key, "left_anti"))
