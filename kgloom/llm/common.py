"""What the operators of this package share: staging, row maps over Arrow batches, word splitting."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: U+0020 and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of this machine only where the setting is missing in a local run."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"kgloom-{os.getuid()}")
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/kgloom-stage/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later step reads."""
    jvm = df.sparkSession._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles() if "/kgloom-stage/" in f}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Spark keeps Python workers for the next stage: what this one freed goes back to the system first."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def others(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df that clash with none of names, whatever their case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], added: T.StructType, text: str = "text",
              block: int = 4 << 20) -> DataFrame:
    """df with the columns `added`, one value each per row, computed from the text column in Python.

    make() runs once per task and returns a function from a list of texts (None for null) to a list of tuples.
    Columns of df that clash with `added` give way to the new ones. Texts go in blocks of about `block` characters.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = others(df, added.fieldNames())
    out = T.StructType([f for f in df.schema.fields if f.name in keep] + added.fields)
    given = df.select(*[quoted(c) for c in keep], *([] if text in keep else [quoted(text).alias("_text")]))
    source = keep.index(text) if text in keep else len(keep)
    kinds = list(to_arrow_schema(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(source)
            for lo, hi in blocks(column, block):
                part = batch.slice(lo, hi - lo)
                rows = work(column.slice(lo, hi - lo).to_pylist())
                new = [pa.array([r[i] for r in rows], type=k.type) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + new,
                                                 names=keep + [k.name for k in kinds])
        del work
        give_back()

    return given.mapInArrow(run, out)


def blocks(column, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column, of about `size` bytes each and one row at least."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lengths:
        yield lo, len(lengths)
