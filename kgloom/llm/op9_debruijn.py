"""Substring dedup over a compacted De Bruijn graph of words.

Edges are 20-word windows (k-mers), nodes the 19 words that consecutive edges share. Only repeated edges matter: an
exchange of packed keys finds them (packed.py), and unrepeated text leaves there. Every place of a node beside a repeated edge then
tells which edges enter and leave it; a node that all its places enter by one edge and leave by one other is nonbranching.
Runs of edges through nonbranching nodes are compacted to one path, which every place of the path shows whole.

A path's places meet by their words: a chunk (a bounded part of the corpus) sends one row a path, with a 128-bit digest of
the path's very words, its places there as source coordinates, and the least of them. A Spark aggregation with partial sums
finds the first place of all, a join with nothing but partial sums above it carries that back, and at every later place
(greater id, or same id and later start) all the path's words go. Windows are judged on the input.

Edges and nodes are 64-bit hashes: edges that collide could only split or offer paths, which their words then tell apart. Hot words
or copies don't gather: keys and paths are distinct in a chunk, and a path has one row a chunk at most.

Ids are integers, or cast to them. Null or empty text: no words, nothing removed. Ids that are null stand after all others.
Rows with equal ids have equal coordinates, neither is earlier, so windows at the same start in both are kept. A text of any length is
one row of one chunk, in memory a few times. Columns that clash with the results give way. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed
from .common import documents, others, quoted

WINDOW = 20
U64 = np.uint64
PATHS = "chunk long, path binary, n int, none boolean, id long, start int, size int, places binary"


class Chunk:
    """Word windows of a chunk's texts."""

    def __init__(self, texts: list[bytes], k: int) -> None:
        self.words, self.at = packed.word_hashes(texts)
        self.edges = packed.windows(self.words, k)
        self.nodes = packed.windows(self.words, k - 1, 1)
        # a window is real if it starts and ends in the same text
        owner = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.owner = owner
        self.real = owner[: len(self.edges)] == owner[k - 1: k - 1 + len(self.edges)] if len(self.edges) else np.zeros(0, bool)
        self.keys, self.inverse, self.counts = np.unique(self.edges[self.real], return_inverse=True, return_counts=True)

    def hot(self, codes: np.ndarray) -> np.ndarray:
        """Where a repeated edge starts, over all windows."""
        out = np.zeros(len(self.edges), bool)
        out[self.real] = ((codes > 0) | (self.counts > 1))[self.inverse]
        return out

    def crossings(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node hash, entering edge, leaving edge) at each end of a repeated edge; 0 for none."""
        n = len(hot)
        place = np.zeros(n + 1, bool)  # node i lies between edge i - 1 and edge i
        place[:-1] |= hot
        place[1:] |= hot
        i = np.flatnonzero(place)
        mark = (self.edges | U64(1 << 63)) if n else self.edges
        enter, leave = np.zeros(len(i), U64), np.zeros(len(i), U64)
        has = (i > 0) & np.where(i > 0, hot[i - 1], False)
        enter[has] = mark[i[has] - 1]
        has = i < n
        has[has] = hot[i[has]]
        leave[has] = mark[i[has]]
        return i, enter, leave


def _edges(k: int, text: str):
    def keys(table):
        return (Chunk(packed.utf8(table.column(text).to_pylist()), k).keys,)

    return keys


def _nodes(c: Chunk, codes: np.ndarray) -> tuple:
    """Distinct nodes in order, with the one entering and the one leaving edge (0 if they differ or are missing)."""
    hot = c.hot(codes)
    i, enter, leave = c.crossings(hot)
    node = c.nodes[i]
    order = np.argsort(node, kind="stable")
    node, enter, leave = node[order], enter[order], leave[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
    out = []
    for side in (enter, leave):
        if not len(first):
            out.append(np.zeros(0, U64))
            continue
        low, high = np.minimum.reduceat(side, first), np.maximum.reduceat(side, first)
        out.append(np.where(low == high, low, U64(0)))
    return node[first], *out


def _pack(node: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> bytes:
    return packed.planes(node) + enter.tobytes() + leave.tobytes()


def _plain(blobs: list[bytes]) -> list[np.ndarray]:
    """1 where a node is nonbranching: entered by one edge and left by one, everywhere."""
    parts = [(packed.unplanes(b[: len(b) // 3], U64), *np.frombuffer(b[len(b) // 3:], U64).reshape(2, -1)) for b in blobs]
    node, enter, leave = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(node, kind="stable")
    node = node[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    ok = np.ones(len(first), bool)
    for side in (enter[order], leave[order]):
        low, high = np.minimum.reduceat(side, first), np.maximum.reduceat(side, first)
        ok &= (low == high) & (low > 0)
    out = np.zeros(len(node), np.uint8)
    out[order] = np.repeat(ok, np.diff(np.r_[first, len(node)]))
    return [out[lo: lo + len(p[0])] for lo, p in zip(np.cumsum([0] + [len(p[0]) for p in parts[:-1]]), parts, strict=True)]


def ordered(table, doc_id: str, text: str):
    """A chunk's rows in an order that doesn't depend on how they came; rows equal in both columns are alike."""
    return table.sort_by([(doc_id, "ascending"), (text, "ascending")])


def paths_of(table, replies, k: int, text: str, doc_id: str):
    """The compacted paths of a chunk with their places, as PATHS."""
    import pyarrow as pa

    from .common import give_back

    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["chunk", "path", "n", "none", "id", "start", "size", "places"]
    rows: list[tuple] = []
    if len(table):
        table = ordered(table, doc_id, text)
        chunk, ids = table.column("chunk")[0].as_py(), table.column(doc_id).cast(pa.int64()).to_pylist()
        texts = packed.utf8(table.column(text).to_pylist())
        c = Chunk(texts, k)
        hot = c.hot(packed.replies_of(replies, 1))
        plain_of = packed.replies_of(replies, 2)
        i, _, _ = c.crossings(hot)
        _, inverse = np.unique(c.nodes[i], return_inverse=True)
        plain = np.zeros(len(hot) + 1, bool)
        plain[i] = plain_of[inverse] > 0
        at = np.flatnonzero(hot)
        # an edge opens a path unless the edge before it is repeated and the node between doesn't branch
        joined = np.zeros(len(at), bool)
        if len(at) > 1:
            joined[1:] = (at[1:] == at[:-1] + 1) & plain[at[1:]]
        first = np.flatnonzero(~joined)
        last = np.r_[first[1:], len(at)] - 1 if len(first) else first
        start = at[first]
        size = at[last] - start + k  # in words
        row = c.owner[start] if len(start) else start
        start = start - c.at[row]
        del c, hot, plain, i, inverse, at, joined
        found: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
        ws, here = [], -1
        for r, lo, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
            if r != here:
                ws, here = texts[r].split(), r  # of bytes: at U+0020 and U+0009 to U+000D
            found.setdefault((hashlib.blake2b(b" ".join(ws[lo: lo + n]), digest_size=16).digest(), n), []).append((r, lo))
        for (path, n), places in found.items():
            none, least, lo = min((ids[r] is None, ids[r] or 0, lo) for r, lo in places)
            rows.append((chunk, path, len(places), none, least, lo, n, np.array(places, "<i4").tobytes()))
    out = pa.table({name: pa.array([r[x] for r in rows], kind) for x, (name, kind) in enumerate(zip(names, kinds, strict=True))})
    give_back()
    return out


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Chunked docs, and (chunk, spans): paths with places that come later than `first`, as (first, size, places)."""
    chunked, total = packed.in_chunks(docs, text)
    n_keys = total // 6
    repeated = packed.exchange(chunked, _edges(window, text), packed.repeated, n_keys).withColumn("step", F.lit(1))

    def nodes(table, replies):
        return _nodes(Chunk(packed.utf8(table.column(text).to_pylist()), window), packed.replies_of(replies)) if len(table) else (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64))

    plain = packed.exchange(chunked, nodes, _plain, n_keys // 4, _pack, extra=repeated).withColumn("step", F.lit(2))
    both = repeated.unionByName(plain)
    paths = chunked.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(lambda t, r: paths_of(t, r, window, text, doc_id), PATHS)
    coordinate = F.struct("none", "id", "start")
    first = paths.groupBy("path").agg(F.min(coordinate).alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
    later = paths.join(first, "path").where((F.col("n") > 1) | (coordinate > F.col("first")))
    spans = later.groupBy("chunk").agg(F.collect_list(F.struct("first", "size", "places")).alias("spans"))
    return chunked, spans


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, full: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if full, kept_text (kept words joined by one space)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    added = T._parse_datatype_string("n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * full)
    names = added.fieldNames()
    keep = others(docs, [*names, "chunk"])
    given = docs.select(*[quoted(c) for c in keep])
    chunked, spans = removed_spans(given, doc_id, text, window)
    out = T.StructType([f for f in given.schema.fields if f.name != text] + added.fields)

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        table = ordered(table, doc_id, text)
        rows: list[list] = [[] for _ in names]
        drop: dict[int, list[tuple[int, int]]] = {}
        ids = table.column(doc_id).cast(pa.int64()).to_pylist()
        for spans in found.column("spans").to_pylist():
            for s in spans:
                first = s["first"]["none"], s["first"]["id"], s["first"]["start"]
                for r, lo in np.frombuffer(s["places"], "<i4").reshape(-1, 2).tolist():
                    if (ids[r] is None, ids[r] or 0, lo) > first:
                        drop.setdefault(r, []).append((lo, lo + s["size"]))
        for i, t in enumerate(packed.utf8(table.column(text).to_pylist())):
            ws = t.split()
            n = len(ws)
            if i in drop:
                gone = np.zeros(n + 1, np.int32)
                for lo, hi in drop[i]:
                    gone[lo] += 1
                    gone[hi] -= 1
                ws = [w for w, g in zip(ws, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
            kept = b" ".join(ws)
            for column, x in zip(rows, (n, n - len(ws), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if full else None), strict=False):
                column.append(x)
        left = table.drop_columns(["chunk", text])
        for name, column, f in zip(names, rows, added.fields, strict=True):
            left = left.append_column(name, pa.array(column, pa.string() if f.dataType == T.StringType() else pa.int64()))
        del rows, table
        packed.give_back()
        return left

    return chunked.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, out)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text"), full=False)
