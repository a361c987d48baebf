"""N-gram Jaccard join: size-banded tiles, hashed bitmaps as upper bounds, exact intersection of sorted arrays.

1. Every document's set of distinct 5-word shingles becomes a sorted array of 64-bit hashes. An exchange of packed keys
   (packed.py) tells each document a code of each shingle's document frequency; 0 stands for a shingle of one document.
2. Shingles are ordered by rarity. Of two sets that link, the prefixes of n - ceil(0.8 n) + 1 shingles share one. The
   shingles of one document come first and can't be shared, so a document with as many of those as its prefix is long
   links to none and leaves here: what goes on are copies and near copies. Equal sets become one node.
3. Nodes meet in tiles: (shared prefix shingle, band of sizes), with the next band visiting, as sizes that link differ by a
   quarter at most. Large tiles split into blocks, a pair of blocks a task. In a tile, popcounts of the nodes' hashed
   bitmaps bound the overlap from above; pairs that the bound leaves are intersected exactly. First come rounds of stars: a node
   of each tile is its centre and meets those that it isn't connected with yet. The first centre is the least odd node, as
   originals are among edited copies, later ones are drawn by a hash; the rounds go on while they connect much. The last
   step compares all the pairs that are not yet connected, whatever tile they share, so no link between components is
   missed and groups of thousands of copies don't make all their pairs.
4. Links make components by label propagation on tables.

No caps: prefixes, tiles and bounds are exact; only 64-bit hash collisions (128 for whole sets) could mislead.

Null or empty text has no shingles and links with nothing. Fewer words than 5 make one shingle of them all. Equal ids are
separate rows; a null id takes its component's least id, and stays null alone. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed
from .common import documents, others, quoted, remove, stage
from .graph import components

WORDS, PERCENT = 5, 80
#: Nodes a tile's block has at most, about.
TILE = 2048
#: Bits of a bitmap for an element, at least: few elements share one, so the bound is near the overlap.
SPREAD = 8
#: Star rounds go on while one finds this share of the links that the best one found.
WORTH = 0.02
U64 = np.uint64


def shingles(texts: list, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ASCII letters in lower case."""
    words, at = packed.word_hashes([t.lower() for t in packed.utf8(texts)])
    runs = packed.windows(words, size)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(runs[lo: hi - size + 1]))
        else:
            out.append(packed.windows(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, U64))
    return out


def _keys(text: str):
    def keys(table):
        found = shingles(table.column(text).to_pylist())
        return np.unique(np.concatenate([np.zeros(0, U64), *found]), return_counts=True)

    return keys


def _pack(buckets: int):
    def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
        more = np.flatnonzero(counts > 1).astype(np.uint32)
        return (len(keys).to_bytes(4, "little") + packed.planes(packed.inside(keys, buckets)) + more.tobytes() + counts[more].astype(np.uint32).tobytes())

    return pack


def _frequencies(blobs: list[bytes]) -> list[np.ndarray]:
    """A code of each key's number of documents: 0 for one, else from 9 up, eight to a doubling."""
    keys, counts, sizes = [], [], []
    for b in blobs:
        n = int.from_bytes(b[:4], "little")
        keys.append(packed.unplanes(b[4: 4 + 4 * n], np.uint32))
        c = np.ones(n, np.int64)
        rest = np.frombuffer(b[4 + 4 * n:], np.uint32)
        c[rest[: len(rest) // 2]] = rest[len(rest) // 2:]
        counts.append(c)
        sizes.append(n)
    joined, total = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sums = np.add.reduceat(total[order], first)
    codes = np.where(sums > 1, np.minimum(255, 1 + (8 * np.log2(sums)).astype(np.int64)), 0).astype(np.uint8)
    out = np.empty(len(joined), np.uint8)
    out[order] = np.repeat(codes, np.diff(np.r_[first, len(joined)]))
    return np.split(out, np.cumsum(sizes)[:-1])


def need(n: int) -> int:
    """Least overlap of a set of n with one that it links to."""
    return -(-PERCENT * n // 100)


def bitmap(tokens: np.ndarray) -> bytes:
    """Hashed bits of a set, SPREAD to twice as many for each element by its size, 64 at least."""
    width = max(64, 1 << int(SPREAD * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[packed.mix(tokens) & U64(width - 1)] = 1
    return np.packbits(bits).tobytes()


def profiles(docs: DataFrame, text: str, keep_text: bool = False) -> DataFrame:
    """Of every document: its columns (the text only if keep_text), n_shingles, and for those that may link the set's key, sorted
    tokens, the shared tokens of its prefix, and its oddness: the share of tokens that no other document has. An original
    is less odd than its edited copies."""
    chunked, total = packed.in_chunks(docs, text)
    n_keys = total // 6
    buckets = max(1, -(-n_keys // packed.BUCKET_KEYS))
    codes = packed.exchange(chunked, _keys(text), _frequencies, n_keys, _pack(buckets))
    added = T._parse_datatype_string("n_shingles bigint, set_key binary, tokens binary, prefix array<bigint>, oddness double")
    out = T.StructType([f for f in docs.schema.fields if keep_text or f.name != text] + added.fields)

    def look(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], []]
        if len(table):
            found = shingles(table.column(text).to_pylist())
            every = np.unique(np.concatenate([np.zeros(0, U64), *found]))
            reply = packed.replies_of(replies)
            for s in found:
                n = len(s)
                code = reply[np.searchsorted(every, s)] if n else np.zeros(0, np.uint8)
                alone, length = int(np.count_nonzero(code == 0)), n - need(n) + 1
                row = (n, None, None, None, None)
                if n and alone < length:
                    shared = np.flatnonzero(code)
                    rare = shared[np.lexsort((s[shared], code[shared]))][: length - alone]
                    twice = int(packed.mix(s).sum(dtype=U64)), int(packed.mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))
                    row = n, b"".join(x.to_bytes(8, "little") for x in (n, *twice)), s.astype("<u8").tobytes(), s[rare].view(np.int64).tolist(), alone / n - float(code.mean()) / 1000
                for column, x in zip(rows, row, strict=True):
                    column.append(x)
        left = table.drop_columns(["chunk"] if keep_text else ["chunk", text])
        for name, column, kind in zip(added.fieldNames(), rows, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float64()), strict=True):
            left = left.append_column(name, pa.array(column, kind))
        del rows, table, replies
        packed.give_back()
        return left

    return chunked.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(look, out)


def band(n):
    """Sizes that may link lie in the same band or in neighbouring ones."""
    return F.floor(F.log(n) / float(np.log(1.2501))).cast("int")


def _bits(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _fold(bits: list[bytes]) -> np.ndarray:
    """Bitmaps of one width: wider ones fold to the least, as bits are low bits of a hash."""
    width = min(map(len, bits))
    out = np.zeros((len(bits), width), np.uint8)
    by_size: dict[int, list[int]] = {}
    for i, b in enumerate(bits):
        by_size.setdefault(len(b), []).append(i)
    for size, rows in by_size.items():
        full = _bits([bits[i] for i in rows])
        out[rows] = np.bitwise_or.reduce(full.reshape(len(rows), size // width, width), axis=1)
    return out


def survivors(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs (i, j), those whose bitmaps allow enough overlap: a bit of one set alone is an element of it alone."""
    a, b = bits[i], bits[j]
    only_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
    most = np.minimum(n[i] - only_a, n[j] - only_b)
    return (100 + PERCENT) * most >= PERCENT * (n[i] + n[j])


PAIRS = "a long, b long"


def _tile(table: pa.Table) -> pa.Table:
    """Pairs of a tile's two blocks that lie in different components and may link."""
    node, n, comp = (table.column(c).to_numpy() for c in ("node", "n", "root"))
    home, side = table.column("home").to_numpy(zero_copy_only=False), table.column("block").to_numpy()
    x, y = int(table.column("x")[0].as_py()), int(table.column("y")[0].as_py())
    bits = _fold(table.column("bits").to_pylist())
    left, right = np.flatnonzero(side == x), np.flatnonzero(side == y)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in left.tolist():
        q = right[(comp[right] != comp[p]) & (home[right] | home[p]) & (100 * np.minimum(n[right], n[p]) >= PERCENT * np.maximum(n[right], n[p]))]
        if x == y:
            q = q[node[q] > node[p]]
        if len(q):
            q = q[survivors(n, bits, np.full(len(q), p), q)]
            a.append(np.full(len(q), node[p]))
            b.append(node[q])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that link, by the size of the intersection of their sorted arrays."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(exact, PAIRS)


def _members(nodes: DataFrame) -> DataFrame:
    """(token, tile, home, node, root, oddness): every node at home in its own band's tile, and visiting the next lower band's."""
    at = nodes.select("node", "n", "oddness", "root", F.explode("prefix").alias("token"))
    return at.select("token", "node", "n", "oddness", "root", F.explode(F.array(
        F.struct(band(F.col("n")).alias("tile"), F.lit(True).alias("home")), F.struct((band(F.col("n")) - 1).alias("tile"), F.lit(False).alias("home")))).alias("t")).select(
            "token", "t.*", "node", "oddness", "root")


KEY = ["token", "tile"]


def _star(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of a tile's centre, a node at home, with the nodes that it isn't connected with: the least odd one first, then
    by a hash of the turn."""
    rank = F.col("oddness") if not turn else F.xxhash64(F.lit(turn), "node")
    lead = members.where("home").groupBy(*KEY).agg(F.min(F.struct(rank.alias("rank"), "node", "root")).alias("lead"))
    other = members.select(*KEY, "node", "root").join(lead, KEY).where(F.col("root") != F.col("lead.root"))
    return other.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _rooted(light: DataFrame, found: DataFrame) -> DataFrame:
    roots = components(found)
    out = stage(light.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    remove(roots)
    return out


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, n, tokens, bits, prefix, oddness) that connect every component."""
    light = nodes.select("node", "n", "prefix", "oddness", F.col("node").alias("root"))
    known, found, most, turn = light, None, 0, 0
    while True:
        new = stage(_linked(_allowed(_star(_members(known), turn), nodes), nodes))
        n = new.count()
        if found is None:
            found = new
        elif n:
            before, found = found, stage(found.union(new))
            remove(before)
            remove(new)
        if n:
            old, known = known, _rooted(light, found)
            if old is not light:
                remove(old)
        most, turn = max(most, n), turn + 1
        # the second centre is tried in any case: what an original leaves may have another one
        if turn > 1 and n <= WORTH * most:
            break
    # then every pair that still lies in different components of a tile; tiles of the same nodes are looked at once
    members = _members(known).drop("oddness")
    who = lambda salt: F.sum(F.pmod(F.xxhash64(F.lit(salt), "node", "home"), F.lit(1 << 40)))
    mixed = members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("home").alias("any"), who(1).alias("s1"), who(2).alias("s2")).where("low <> high and any")
    mixed = mixed.groupBy("tile", "size", "s1", "s2").agg(F.min("token").alias("token")).select(*KEY, F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    dealt = members.join(mixed, KEY).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(nodes.select("node", "n", "bits"), "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *KEY, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "home", "node", "n", "bits", "root")
    pairs = dealt.groupBy(*KEY, "x", "y").applyInArrow(_tile, PAIRS).distinct()
    return found.union(stage(_linked(pairs, nodes)))


def _allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and bitmaps allow a link."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    near = pairs.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def bound(batches):
        for batch in batches:
            size = batch.num_rows
            if size:
                bits = [_fold([x, y]) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)]
                n = [np.array([x, y]) for x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)]
                keep = [bool(survivors(m, b, np.array([0]), np.array([1]))[0]) for m, b in zip(n, bits, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(bound, PAIRS)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without the text unless keep_text) with n_shingles, component_id, and is_first: true for one row of each
    component, that of the least id."""
    taken = ["chunk", "n_shingles", "oddness", "component_id", "is_first", "set_key", "tokens", "prefix", "_least", "_row"]
    given = docs.select(*[quoted(c) for c in others(docs, taken)])
    found = stage(profiles(given, text, keep_text).withColumn("_row", F.monotonically_increasing_id()))
    # null ids are last, and structs order by their first field that differs
    least = F.min(F.struct(quoted(doc_id).isNull().alias("none"), quoted(doc_id).alias("id"), F.col("_row").alias("row")))
    sets = found.where("set_key is not null").groupBy("set_key").agg(
        least.alias("least"), F.first("n_shingles").alias("n"), F.first(F.struct("tokens", "prefix", "oddness")).alias("s"))
    bits = F.pandas_udf(_bitmaps, "binary")
    # numbered in the order of their least ids: a component's least node has its least id, and no group gathers a component
    ordered = sets.repartitionByRange("least").sortWithinPartitions("least")
    nodes = stage(ordered.select(F.monotonically_increasing_id().alias("node"), "set_key", "least", "n", "s.tokens", "s.prefix", "s.oddness", bits("s.tokens").alias("bits")))
    roots = components(links(nodes))
    placed = nodes.select("node", "set_key").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    labels = stage(placed.join(nodes.select(F.col("node").alias("root"), F.col("least").alias("_least")), "root").select("set_key", "_least"))
    keep = [quoted(c) for c in given.columns if keep_text or c != text]
    least_id = F.coalesce("_least.id", quoted(doc_id)).alias("component_id")
    linked = found.where("set_key is not null").join(labels, "set_key").select(*keep, "n_shingles", least_id, (F.col("_row") == F.col("_least.row")).alias("is_first"))
    # most documents have no key: joining them would send all to the task of the null key
    alone = found.where("set_key is null").select(*keep, "n_shingles", quoted(doc_id).alias("component_id"), F.lit(True).alias("is_first"))
    return linked.unionByName(alone)


def _bitmaps(tokens):
    import pandas as pd

    return pd.Series([bitmap(np.frombuffer(t, "<u8")) for t in tokens])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir).select("doc_id", "text")).drop("is_first")
