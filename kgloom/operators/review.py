"""The review queue and job states as append-only event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMINAL = ["extracted", "failed", "queued"]


def numbered(rows: DataFrame, first: int = 1) -> DataFrame:
    """New items as pending events with ids REV001 on. rows: ord."""
    from .dedup import sequence_ids

    return sequence_ids(rows, "REV", 3, ["ord"], first).withColumnRenamed("seq_id", "id").withColumn("status", F.lit("pending"))


def latest(events: DataFrame, key: str = "id") -> DataFrame:
    """The status of each item after all events, in order: an approval counts only while pending, a rejection always. Only the last
    event that is no approval matters, and whether an approval follows it: sums that combine, however many events a key has."""
    other = F.col("status") != "approved"
    g = events.groupBy(key).agg(F.max_by(F.when(other, F.col("status")), F.when(other, F.col("seq"))).alias("anchor"), F.max(F.when(other, F.col("seq"))).alias("at"),
                                F.max(F.when(~other, F.col("seq"))).alias("approved"), F.max("seq").alias("seq"))
    counts = F.coalesce("anchor", F.lit("pending")) == "pending"
    return g.select(key, F.when(counts & (F.col("approved") > F.coalesce("at", F.lit(-1 << 62))), "approved").otherwise(F.col("anchor")).alias("status"), "seq")


def by_status(items: DataFrame, status: str = "all", needle: str | None = None) -> DataFrame:
    out = items if status == "all" else items.where(F.col("status") == status)
    return out if not needle else out.where(F.contains("id", F.lit(needle)) | F.contains(F.to_json("data"), F.lit(needle)))


def job_state(events: DataFrame, key: str = "job_id") -> DataFrame:
    """The last event of each job."""
    rest = [c for c in events.columns if c not in (key, "seq")]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("_l"), F.max("seq").alias("seq")).select(key, "seq", "_l.*")


#: Which states of a job may follow each.
NEXT = {"uploaded": ["extracting"], "extracting": ["cleaning", "extracted", "failed"], "cleaning": ["extracting", "failed"], "extracted": ["queued", "extracting"], "failed": ["extracting"], "queued": ["extracting"]}


def transitions(events: DataFrame, key: str = "job_id", allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, seq, status, before) of events whose state may not follow the one before; the first may be any."""
    allowed = NEXT if allowed is None else allowed
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    e = events.select(key, "seq", "status", F.lag("status").over(W.partitionBy(key).orderBy("seq")).alias("before"))
    return e.where(F.col("before").isNotNull() & ~F.concat_ws(">", "before", "status").isin(*pairs))


def job_status(events: DataFrame, job: str) -> DataFrame:
    """The last event of one job; no row if there is none, for which the caller answers."""
    return job_state(events.where(F.col("job_id") == job))


def takes(filename):
    """Whether an upload's name is one of a job: a PDF's."""
    return F.endswith(F.lower(F.coalesce(filename, F.lit(""))), F.lit(".pdf"))


def replay(base: DataFrame, items: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base after approved items (seq, action, key, columns) in order: add writes the columns, update writes those that aren't null
    where the node exists, delete removes it. As in apply.py, sums that combine take the place of a fold."""
    from . import apply

    values = F.struct(*[F.col(c) for c in columns])
    events = base.select(F.col(key).alias("key"), F.lit(apply.BASE).cast("bigint").alias("seq"), F.lit("add").alias("action"), values.alias("values")).unionAll(
        items.select(F.col(key), F.col("seq").cast("bigint"), "action", values))
    return apply._nodes(events, apply._alive(events), columns).withColumnRenamed("key", key)


def preview(df: DataFrame, n: int) -> DataFrame:
    return df.limit(max(1, min(n, 200)))
