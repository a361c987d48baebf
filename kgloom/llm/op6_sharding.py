"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame expressions only.

Each shard owns virtual nodes on a ring of fixed slots; a key starts at the slot its id hashes to and belongs to the
first virtual node clockwise. Loads are bounded: shard s takes at most floor or ceiling of rows / shards, so keys that
overflow a full shard continue clockwise to the next shard with room. All rows are placed, so counts are at most one
apart, and only the overflow leaves its home shard.

Placement needs only the rows of each slot: the driver holds one count per ring slot (a constant number), decides which
ranks of a slot go where, and rows find their interval by a join on (slot, rank). Ranks come from windows over
(slot, cell) with as many cells as keep a window small, by the row's own number in the staged key table, so equal ids
and equal rows spread too.

Null text has size 1 and checksum 0 (that of no bytes); null ids share one slot and overflow from there. Rows with equal
ids or equal contents are placed one by one. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, quoted, stage

SHARDS, NODES, SLOTS = 16, 64, 4096
#: Rows a cell has, about; cells of a slot grow in number with the table.
CELL_ROWS = 100_000


def ring(shards: int, nodes: int, slots: int | None = None) -> list[int]:
    """The shards that own each slot: that of the first virtual node at or after it, clockwise."""
    slots = slots or SLOTS
    at: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            place = zlib.crc32(f"{shard}:{node}".encode()) % slots
            while place in at and len(at) < slots:
                place = (place + 1) % slots
            at.setdefault(place, shard)
    owner, last = [0] * slots, at[min(at)]
    for slot in range(slots - 1, -1, -1):
        last = at.get(slot, last)
        owner[slot] = last
    return owner


def place(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, end rank, shard, first place in the shard) of all rows, with counts[slot] rows in each slot.

    First every slot fills its home up to the bound; then what is left over continues clockwise.
    """
    total, out = sum(counts), []
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    left: list[tuple[int, int]] = []

    def put(slot: int, lo: int, shard: int) -> int:
        n = min(counts[slot] - lo, room[shard] - filled[shard])
        if n > 0:
            out.append((slot, lo, lo + n, shard, filled[shard]))
            filled[shard] += n
        return lo + max(n, 0)

    for slot, n in enumerate(counts):
        if n and (done := put(slot, 0, owner[slot])) < n:
            left.append((slot, done))
    for slot, done in left:
        step = slot
        while done < counts[slot]:
            step = (step + 1) % len(owner)
            done = put(slot, done, owner[step])
    return out


def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, doc_id: str = "doc_id", text: str = "text",
          cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard) of every row of docs."""
    spark = docs.sparkSession
    t = F.coalesce(quoted(text), F.lit(""))
    keys = stage(docs.select(
        quoted(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(quoted(doc_id)), F.lit(SLOTS)).cast("int").alias("_ring"), F.monotonically_increasing_id().alias("_row")))
    cells = max(1, -(-keys.count() // (SLOTS * cell_rows)))
    keys = keys.withColumn("_cell", F.pmod(F.xxhash64("_row"), F.lit(cells)))
    sizes = keys.groupBy("_ring", "_cell").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(W.partitionBy("_ring").orderBy("_cell")) - F.col("n")).drop("n")
    counts = [0] * SLOTS
    for r in sizes.groupBy("_ring").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        counts[r["_ring"]] = r["n"]
    owner = ring(shards, nodes)
    plan = place(counts, owner, shards)
    rows = json.dumps([{"r": a, "lo": b, "hi": c, "s": d, "at": e} for a, b, c, d, e in plan])  # SLOTS + shards rows at most
    where = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<r int, lo bigint, hi bigint, s int, at bigint>>")))
    ranked = keys.withColumn("_rank", F.row_number().over(W.partitionBy("_ring", "_cell").orderBy("_row")) - 1)
    if cells > 1:
        ranked = ranked.join(before, ["_ring", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    k, p = ranked.alias("k"), F.broadcast(where).alias("p")
    return k.join(p, (F.col("k._ring") == F.col("p.r")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("s").alias("shard"),
        (F.col("at") + F.col("_rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.get(F.lit(owner), F.col("_ring")).cast("int").alias("home_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir).select("doc_id", "text")).drop("home_shard")
