"""The tree of prefixes that conversations share.

A node is a distinct sequence of first turns. Of all conversations that start with it the one of least id owns it; who owns a
prefix owns every longer one of its own, so a conversation owns a chain: its turns from a first owned depth on. That depth is found by
binary search: each round joins the digest of every open conversation's middle prefix with the least ids of shared digests
(one not shared is the conversation's own) and keeps half of the digests, so all rounds together move twice what the first
moves. The last prefix that isn't owned names the chain above. Sums over the tree go up from chain to chain by pointer doubling: each round
a chain hands its sum to the chain that its pointer names, and the pointer doubles its reach, so the rounds are the logarithm of the tree's
height in chains. Nodes within a chain take the sums of what hangs at or below them.

A prefix's digest is the exclusive or of two 64-bit hashes of its turns with their depths: it needs no order of evaluation, so a
conversation of any length is cut into blocks of BLOCK depths (running()), and turns are numbered by a range sort, not by a
window over a conversation. A prefix, a first turn or a whole conversation that most conversations share is one key of a
partial aggregation, or the large side of a join that Spark may split. Results are exact up to collisions of 128 bits.

Turns are ordered by turn, null first, then role and text; null roles and texts count as empty; repeated rows are turns of their own.
Rows without conv_id are left out. Remainders of negative ids follow SQL. A conversation without turns is a member of the root. An empty table
gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, remove, stage

#: Depths of a conversation that one row or window holds, and ids that one row of ends holds (as a power of two).
BLOCK, END_BITS = 256, 12
#: Conversations come in groups of FAMILY ids; a member takes fewer than HEADS turns from the first of its group.
FAMILY, HEADS = 5, 9


def running(rows: DataFrame, sums: dict[str, tuple[Callable[[Column], Column], str]], key: str = "conv_id", at: str = "depth") -> DataFrame:
    """rows with, for each name of sums, the (aggregate, column) over the rows of the key at smaller places. Windows are blocks of
    BLOCK places; what is before a block comes from one row a block. Aggregates are sum or bit_xor; no column is null."""
    rows = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    join = {name: (Column.bitwiseXOR if f is F.bit_xor else Column.__add__) for name, (f, _) in sums.items()}
    inside = W.partitionBy(key, "_block").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumns({name: F.coalesce(f(F.col(c)).over(inside), F.lit(0)) for name, (f, c) in sums.items()})
    totals = rows.groupBy(key, "_block").agg(*[f(F.col(c)).alias(f"_{name}") for name, (f, c) in sums.items()])
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumns({f"_{name}": f(F.col(f"_{name}")).over(before) for name, (f, _) in sums.items()}).where(F.col(f"_{next(iter(sums))}").isNotNull())
    both = local.join(carry, [key, "_block"], "left")
    return both.select(*[c for c in rows.columns if c != "_block"], *[join[name](F.col(name), F.coalesce(f"_{name}", F.lit(0))).alias(name) for name in sums])


def turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, a, b, bytes): every turn by its place from 1, as two hashes and the bytes of its text."""
    empty = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    t = df.select(quoted(conv_id).cast("bigint").alias("conv_id"), quoted(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "text", "row"]
    sorted_ = t.where("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(name) for seed, name in enumerate("ab")]
    ranged = stage(sorted_.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *hashes, F.octet_length("text").cast("bigint").alias("bytes")))
    pieces = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("zero"), F.count(F.lit(1)).alias("n"))
    before = pieces.withColumn("before", F.sum("n").over(W.partitionBy("conv_id").orderBy("part")) - F.col("n"))
    return ranged.join(before, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("zero") + F.col("before") + 1).alias("pos"), "a", "b", "bytes")


def rebuild(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns (conv_id, depth, a, b, bytes), conversations (conv_id, length)): the head of each conversation comes from the first of its family."""
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    given = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.col("n").alias("there"))
    about = convs.withColumns({"first": first, "h": heads}).join(given, "first", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    about = stage(about.select("conv_id", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    donors = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "first")
    head = donors.join(about, "first").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "a", "b", "bytes")
    rest = own.join(about.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    return head.unionAll(rest), about.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, ds): for each block of depths an array of (depth, a, b, upto, bytes): the digest of the prefix, the bytes up to its end and those of its last turn."""
    keyed = stage(rows.select("conv_id", "depth", F.xxhash64("depth", "a").alias("ka"), F.xxhash64("depth", "b").alias("kb"), "bytes"))
    run = running(keyed, {"xa": (F.bit_xor, "ka"), "xb": (F.bit_xor, "kb"), "before": (F.sum, "bytes")})
    one = F.struct("depth", F.col("xa").bitwiseXOR(F.col("ka")).alias("a"), F.col("xb").bitwiseXOR(F.col("kb")).alias("b"), (F.col("before") + F.col("bytes")).alias("upto"), "bytes")
    blocks = stage(run.groupBy("conv_id", F.floor(F.col("depth") / BLOCK).alias("_block")).agg(F.sort_array(F.collect_list(one)).alias("ds")).select("conv_id", "ds"))
    remove(keyed)
    return blocks


def first_owned(blocks: DataFrame) -> DataFrame:
    """(conv_id, first, above): the first depth that a conversation owns (null: none) and, of the last that it doesn't, (depth, owner, upto)."""
    shared = stage(blocks.select("conv_id", F.explode("ds").alias("d")).groupBy("d.a", "d.b").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    most = blocks.agg(F.max(F.size("ds")).alias("n")).first()["n"] or 0
    opened = blocks.select("conv_id", "ds", F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("struct<depth bigint, owner bigint, upto bigint>").alias("above"))
    steps, found = [], opened.where("size(ds) = 0").drop("ds")
    for _ in range(most.bit_length()):  # BLOCK digests take nine rounds
        probe = opened.withColumn("m", F.floor(F.size("ds") / 2).cast("int")).withColumn("p", F.get("ds", F.col("m")))
        met = probe.join(shared, (F.col("p.a") == shared["a"]) & (F.col("p.b") == shared["b"]), "left")
        mine = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        step = stage(met.select(
            "conv_id", F.when(mine, F.slice("ds", F.lit(1), F.col("m"))).otherwise(F.slice("ds", F.col("m") + 2, F.size("ds"))).alias("ds"),
            F.when(mine, F.col("p.depth")).otherwise(F.col("first")).alias("first"),
            F.when(~mine, F.struct("p.depth", "owner", "p.upto")).otherwise(F.col("above")).alias("above")))
        steps.append(step)
        found, opened = found.unionAll(step.where("size(ds) = 0").drop("ds")), step.where("size(ds) > 0")
    out = stage(found.groupBy("conv_id").agg(F.min("first").alias("first"), F.max("above").alias("above")))
    for t in [*steps, shared]:
        remove(t)
    return out


def chains(owned: DataFrame, convs: DataFrame) -> tuple[DataFrame, int | None]:
    """((conv_id, first, length, above, at, unowned), root's owner): the chain of each conversation hangs at depth `at` of the chain `above`, null for the root's;
    `unowned` are the bytes before its first depth. A chain whose first depth is beyond its length is empty."""
    root = convs.agg(F.min("conv_id").alias("r")).first()["r"]
    top = F.col("conv_id") == F.lit(root)
    at = F.coalesce("above.depth", F.lit(0))
    return stage(convs.join(owned, "conv_id", "left").select(
        "conv_id", F.when(top, 0).otherwise(F.coalesce("first", F.col("length") + 1)).cast("bigint").alias("first"), "length",
        F.when(~top, F.coalesce("above.owner", F.lit(root))).alias("above"), at.cast("bigint").alias("at"), F.coalesce("above.upto", F.lit(0)).cast("bigint").alias("unowned"))), root


def sums_up(rows: DataFrame, columns: list[str], top: int | None) -> DataFrame:
    """(key, ...): rows (key, above, ...) with each column summed over the row and all below it, by pointer doubling. `top` is the key
    that nothing is above."""
    sums, links = stage(rows.select("key", *columns)), stage(rows.where("above is not null").select("key", "above"))
    while not links.isEmpty():
        add = links.join(sums, "key").groupBy(F.col("above").alias("key")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        new = stage(sums.join(add, "key", "left").select("key", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]))
        up = links.select(F.col("key").alias("above"), F.col("above").alias("next"))
        onward = stage(links.where(F.col("above") != top).join(up, "above").select("key", F.col("next").alias("above")))
        remove(sums)
        remove(links)
        sums, links = new, onward
    return sums


def tree(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and the conversations
    (conv_id, depth, end_id) that end at a node. Both name a node by its owner and depth."""
    rows, convs = rebuild(turns(df, conv_id, turn, role, text))
    blocks = prefixes(rows)
    c, root = chains(first_owned(blocks), convs)
    some = (F.col("first") <= F.col("length"))
    hanging = c.where(F.col("above").isNotNull() & some).groupBy(F.col("above").alias("conv_id"), F.col("at").alias("length")).agg(F.count(F.lit(1)).alias("kids"))
    leaf = (some & F.col("kids").isNull()).cast("bigint")
    own = c.join(hanging, ["conv_id", "length"], "left").select(F.col("conv_id").alias("key"), "above", F.lit(1).cast("bigint").alias("n"), leaf.alias("leaves"), F.col("unowned").alias("bytes"))
    total = sums_up(own, ["n", "leaves", "bytes"], root)
    full = stage(c.join(total, c["conv_id"] == total["key"]).drop("key"))
    at = full.where("above is not null").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.count_if(some).alias("kids"), *[F.sum(x).alias(f"{x}_at") for x in ("n", "leaves", "bytes")])
    inside = blocks.select("conv_id", F.explode("ds").alias("d")).select("conv_id", "d.depth", (F.col("d.upto") - F.col("d.bytes")).alias("before"))
    top = full.where("above is null").select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("before"))
    nodes = inside.unionAll(top).join(full, "conv_id").where(F.col("depth") >= F.col("first")).join(at, ["conv_id", "depth"], "left").na.fill(0, ["kids", "n_at", "leaves_at", "bytes_at"])
    run = running(stage(nodes), {f"{x}_above": (F.sum, f"{x}_at") for x in ("n", "leaves", "bytes")})
    n = F.col("n") - F.col("n_above")
    out = run.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), n.alias("n_convs"),
        (F.col("kids") + (F.col("depth") < F.col("length")).cast("bigint")).alias("n_children"), (F.col("leaves") - F.col("leaves_above")).alias("n_leaves"),
        (F.col("bytes") - F.col("unowned") - F.col("bytes_above") - (n - 1) * F.col("before")).alias("saved_tokens"))
    ends = full.select(F.when(some, F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.when(some, F.col("length")).otherwise(F.col("at")).alias("depth"), F.col("conv_id").alias("end_id"))
    return out, ends


def digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, n_ends, ends_sha256): ids in ascending order, joined by commas. Parts of 2 ** END_BITS ids are joined first; a node's parts pass through a hasher
    one by one, so a node at which most conversations end takes no more memory than another."""
    joined = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("end_id")), lambda x: x.cast("string")))
    parts = ends.groupBy("conv_id", "depth", F.shiftright("end_id", END_BITS).alias("part")).agg(joined.alias("ids"), F.count(F.lit(1)).alias("n"))

    def hash_runs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["conv_id", "depth", "n_ends", "ends_sha256"]
        node, n, sha = None, 0, None
        for batch in batches:
            done = []
            for conv, depth, ids, count in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids", "n")], strict=True):
                if (conv, depth) != node:
                    if node is not None:
                        done.append((*node, n, sha.hexdigest()))
                    node, n, sha = (conv, depth), 0, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
                n += count
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([n]), pa.array([sha.hexdigest()])], names=names)

    run = parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    return run.mapInArrow(hash_runs, "conv_id bigint, depth bigint, n_ends bigint, ends_sha256 string")


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = tree(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests(ends).drop("n_ends"), ["conv_id", "depth"], "left").na.fill({"ends_sha256": none})


#: CRC-32 by its table of 256 steps, as DuckDB has no such function.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1]))"
SQL = f"""WITH crc AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(1 AS BIGINT) for x in range(8)]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
  t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS first, n, xor(4294967295, {_CRC}) % {HEADS} AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc),
  r AS (SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = c.first AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c b ON b.conv_id = c.first),
  m AS (SELECT conv_id, d, strlen(text) AS bytes, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
  nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM m GROUP BY k, d),
  kids AS (SELECT left(k, length(k) - 128) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
  below AS (SELECT m.k, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved FROM nodes b LEFT JOIN kids ON kids.k = b.k JOIN m ON m.conv_id = b.conv_id AND m.d <= b.d GROUP BY m.k),
  ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(k) AS k FROM m GROUP BY conv_id) GROUP BY k)
  SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, below.n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
  FROM nodes n JOIN below ON below.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends ON ends.k = n.k LEFT JOIN nodes p ON n.d > 0 AND p.k = left(n.k, length(n.k) - 128)"""
