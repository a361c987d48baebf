"""Substring dedup at byte level by blockwise suffix sorting with a difference cover.

A byte goes if some string of `window` bytes that covers it also starts anywhere else in the corpus. So suffixes matter
to depth `window` only, and what is asked of their order is which of them tie there.

0. Copies. Of whole texts that are equal, one goes on; if there are several, each of their strings starts elsewhere.
1. Difference cover. Of every document, the samples at places p with p mod V in D, a cover of all differences modulo V, get
   ranks: the class of their window - V + 1 bytes. Any two equal windows, however they lie, have samples at a common
   offset, inside the window. So a suffix none of whose samples has a repeated rank ties with no other, and is done: a
   seventh of the places decides this for all the rest.
2. Blocks. The suffixes that are left go to buckets, ranges of their fingerprint at depth `window`; a bucket is sorted at
   a time, of bounded size whatever the corpus, and its runs of equal keys are the ties. Suffixes are ordered by 64-bit
   fingerprints, not by bytes: any order serves in which equal strings meet, and this one has no hot prefix buckets.
3. Each chunk reads its suffixes' ties and removes the bytes that they cover.

Keys travel in packed arrays, distinct in a chunk, so that copies don't gather (packed.py). Documents are joined by a byte
run only inside a chunk's memory; windows never cross documents.

Null text counts as empty. Texts shorter than the window keep every byte. Repeated rows and equal ids are separate
documents: each is repeated elsewhere. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed
from .common import documents, others, quoted

WINDOW = 200
CHUNK_BYTES, SEGMENT = 2 << 20, 1 << 20
#: Perfect difference covers, by modulus.
COVERS = {
    1: [0],
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    31: [0, 1, 3, 8, 12, 18],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
    133: [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109],
}


def cover(window: int) -> tuple[np.ndarray, int]:
    """(membership by residue, length of a sample) of the largest cover that leaves samples two thirds of the
    window: long samples seldom repeat by chance or in stock phrases."""
    v = max(m for m in COVERS if 3 * m <= window or m == 1)
    inside = np.zeros(v, bool)
    inside[COVERS[v]] = True
    return inside, window - v + 1


class Copies:
    """The whole texts of a chunk: which are equal, here and (by the replies) elsewhere."""

    def __init__(self, parts: list[bytes], codes: np.ndarray | None = None) -> None:
        raw = b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts)
        pairs = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        ordered = pairs[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        self.keys = ordered[new]
        if codes is not None:
            group = np.cumsum(new) - 1
            several = (codes > 0) | (np.bincount(group, minlength=len(codes)) > 1)
            #: A text that goes on, and one that has an equal somewhere.
            self.alive, self.several = np.zeros(len(order), bool), np.zeros(len(order), bool)
            self.alive[order] = new & (codes[group] < 2)
            self.several[order] = several[group]


def _pack_copies(first: np.ndarray, second: np.ndarray) -> bytes:
    return first.tobytes() + second.tobytes()


def _copies(blobs: list[bytes]) -> list[np.ndarray]:
    """For each text of each sender, in order: 0 no other has it, 1 this is the first that has it, 2 a later one."""
    parts = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in blobs]
    pairs = np.concatenate(parts, axis=1)
    order = np.lexsort((np.arange(pairs.shape[1]), pairs[1], pairs[0]))
    ordered = pairs[:, order]
    same = (ordered[:, 1:] == ordered[:, :-1]).all(axis=0)
    later, earlier = np.r_[False, same], np.r_[same, False]
    out = np.zeros(len(order), np.uint8)
    out[order] = np.where(later, 2, np.where(earlier, 1, 0))
    return np.split(out, np.cumsum([p.shape[1] for p in parts])[:-1])


class Chunk:
    def __init__(self, parts: list[bytes], window: int) -> None:
        self.window, (self.cover, self.sample) = window, cover(window)
        self.limits = np.cumsum([len(p) for p in parts], dtype=np.int64)
        self.begins = self.limits - [len(p) for p in parts]
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def segments(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, packed.Prefix]]:
        """(start, places, places in their document, bytes left there, hashes) of stretches of bounded size."""
        for a in range(0, len(self.data), SEGMENT):
            p = np.arange(a, min(a + SEGMENT, len(self.data)))
            d = np.searchsorted(self.limits, p, side="right")
            yield a, p, p - self.begins[d], self.limits[d] - p, packed.Prefix(self.data[a: a + SEGMENT + self.window])

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, p, offset, left, prefix in self.segments():
            p = p[self.cover[offset % len(self.cover)] & (left >= self.sample)]
            places.append(p)
            hashes.append(prefix.of(p - a, p - a + self.sample))
        return np.concatenate(places), np.concatenate(hashes)

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        places, hashes = self.samples()
        return places, *np.unique(hashes, return_inverse=True, return_counts=True)

    def suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, fingerprints) of the suffixes with a sample of repeated rank."""
        places, keys, inverse, counts = self.ranked()
        before = np.zeros(len(self.data) + 1, np.int32)
        before[places + 1] = ((codes > 0) | (counts > 1))[inverse]
        before = np.cumsum(before, dtype=np.int32)
        out, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, p, _, left, prefix in self.segments():
            p = p[left >= self.window]
            p = p[before[p + len(self.cover)] > before[p]]
            out.append(p)
            hashes.append(prefix.of(p - a, p - a + self.window))
        return np.concatenate(out), np.concatenate(hashes)

    def removed(self, places: np.ndarray) -> np.ndarray:
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, places, 1)
        np.add.at(step, places + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, full: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, if full, kept (binary) instead of the text."""
    added = T._parse_datatype_string("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * full)
    names = added.fieldNames()
    given = docs.select(*[quoted(c) for c in others(docs, [*names, "chunk"])])
    chunked, total = packed.in_chunks(given, text, chunk_bytes=min(CHUNK_BYTES, packed.CHUNK_BYTES))
    none = np.zeros(0, np.uint64)

    def parts_of(table) -> list[bytes]:
        return packed.utf8(table.column(text).to_pylist())

    def alive(table, replies) -> Chunk:
        parts = parts_of(table)
        return Chunk([p if a else b"" for p, a in zip(parts, Copies(parts, packed.replies_of(replies, 0)).alive, strict=True)], window)

    def texts(table):
        return tuple(Copies(parts_of(table)).keys.T)

    def ranks(table, replies):
        return (alive(table, replies).ranked()[1],) if len(table) else (none,)

    def ties(table, replies):
        return (np.unique(alive(table, replies).suffixes(packed.replies_of(replies, 1))[1]),) if len(table) else (none,)

    inside, _ = cover(window)
    copies = packed.exchange(chunked, texts, _copies, total // 1000, _pack_copies).withColumn("step", F.lit(0))
    ranked = packed.exchange(chunked, ranks, packed.repeated, int(total * inside.mean()), extra=copies).withColumn("step", F.lit(1))
    two = copies.unionByName(ranked)
    tied = packed.exchange(chunked, ties, packed.repeated_whole, total // 8, packed.planes, extra=two).withColumn("step", F.lit(2))
    every = two.unionByName(tied)
    out = T.StructType([f for f in given.schema.fields if f.name != text] + added.fields)
    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in names]
        if len(table):
            parts = parts_of(table)
            whole = Copies(parts, packed.replies_of(replies, 0))
            c = alive(table, replies)
            places, hashes = c.suffixes(packed.replies_of(replies, 1))
            _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            gone = c.removed(places[((packed.replies_of(replies, 2) > 0) | (counts > 1))[inverse]])
            for p, lo, hi, several in zip(parts, c.begins.tolist(), c.limits.tolist(), whole.several.tolist(), strict=True):
                g = np.full(len(p), len(p) >= window) if several else gone[lo:hi]
                kept = np.frombuffer(p, np.uint8)[~g].tobytes()
                spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
                for column, x in zip(rows, (len(p), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    column.append(x)
        left = table.drop_columns(["chunk", text])
        for name, column, kind in zip(names, rows, kinds, strict=False):
            left = left.append_column(name, pa.array(column, kind))
        del rows, table
        packed.give_back()
        return left

    return chunked.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(cut, out)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text"), full=False)
