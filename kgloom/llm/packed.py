"""Which keys of a corpus are repeated, found by exchanging packed arrays instead of rows.

Documents are dealt to chunks of bounded size, in bytes and in rows, by a hash of all their columns and of the input partition (so
that rows that are equal in every column share a chunk only within one input partition). Each chunk has a set of 64-bit keys; it sends
every bucket (a range of key values) one array of its distinct keys in that range, so a key that fills a third of the
corpus is sent once a chunk. A bucket counts its keys and answers each chunk with one byte a key, in the chunk's order.
The chunk, dealt the same way again, recomputes its keys and reads the answers beside its documents.

Memory is bounded by a chunk or a bucket; both grow in number, not in size, with the corpus. A chunk sends at most one message a
bucket that it has keys of, so there are never more messages than keys: where buckets outnumber a chunk's keys (some TB), the
exchange is an ordinary shuffle of one row a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, others, quoted

#: Bytes of text a chunk has, about, and keys a bucket has, about.
CHUNK_BYTES, BUCKET_KEYS = 6 << 20, 1 << 20
#: Rows a chunk has, about, however short its texts are.
CHUNK_ROWS = 100_000
REPLY = "chunk long, bucket int, reply binary"

U64 = np.uint64
_rng = np.random.default_rng(20240613)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Hashes of any substrings of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * self.up[:-1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(U64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than U+0020 and U+0009 to U+000D."""
    inner = np.zeros(len(data) + 2, np.int8)
    inner[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    step = np.diff(inner)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(texts: list[bytes], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, and the number of words before each text (and in all)."""
    out, counts = [np.zeros(0, U64)], [0]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < block):
            size += len(texts[hi]) + 1
            hi += 1
        joined = b" ".join(texts[lo:hi]) + b" "
        starts, ends = word_spans(joined)
        out.append(Prefix(np.frombuffer(joined, np.uint8)).of(starts, ends))
        limits = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        counts += (np.searchsorted(starts, limits) + counts[-1]).tolist()
        lo = hi
    return np.concatenate(out), np.array(counts)


def windows(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of `size` consecutive values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, U64(size + 1000 * salt))
    for j in range(size):
        total = total * _BASE + words[j: j + n]
    return mix(total)


def utf8(texts: list) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def in_chunks(docs: DataFrame, text: str = "text", chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """docs with `chunk`, and the bytes of all texts."""
    given = docs.select(*[quoted(c) for c in others(docs, ["chunk"])])
    size = given.agg(F.sum(F.octet_length(quoted(text))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = size["bytes"] or 0
    n = max(1, -(-total // (chunk_bytes or CHUNK_BYTES)), -(-size["rows"] // CHUNK_ROWS))
    plain = [quoted(c) for c in given.columns]
    return given.select(*plain, F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(n)).alias("chunk")), total


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U64(24)) * U64(buckets)) >> U64(40)


def inside(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The next 32 bits of keys below their bucket, in the same order."""
    return ((((keys >> U64(24)) * U64(buckets)) >> U64(8)) & U64(0xFFFFFFFF)).astype(np.uint32)


def planes(x: np.ndarray) -> bytes:
    """The bytes of x, all first bytes before all second bytes and so on: sorted values compress in a shuffle."""
    return x.view(np.uint8).reshape(len(x), x.itemsize)[:, ::-1].T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T[:, ::-1]).view(kind).ravel()


def exchange(chunked: DataFrame, keys: Callable, answer: Callable, n_keys: int, pack: Callable | None = None,
             extra: DataFrame | None = None) -> DataFrame:
    """REPLY rows of the chunks.

    keys(table[, replies]) gives a chunk's (distinct keys in order, *arrays beside them); pack(*slices) makes the bytes
    that a bucket gets; answer(list of those bytes) gives the bucket's list of byte arrays, one a sender. n_keys is
    about the number of keys and sets the number of buckets. `extra`, by chunk, is handed to keys as replies. All passes take
    chunked as it is, so that its shuffle is made once and read again.
    """
    import pyarrow as pa

    buckets = max(1, -(-n_keys // BUCKET_KEYS))
    pack = pack or (lambda k: planes(inside(k, buckets)))

    def send(table: pa.Table, replies: pa.Table | None = None) -> pa.Table:
        made = keys(table) if replies is None else keys(table, replies)
        chunk = table.column("chunk")[0].as_py() if len(table) else 0
        full, at = np.unique(bucket_of(made[0], buckets), return_index=True)  # keys come in order
        ends = [*at[1:].tolist(), len(made[0])][: len(at)]
        out = pa.table({"chunk": pa.array([chunk] * len(full), pa.int64()), "bucket": pa.array(full.astype(np.int32), pa.int32()),
                        "keys": pa.array([pack(*(x[lo:hi] for x in made)) for lo, hi in zip(at.tolist(), ends, strict=True)], pa.binary())})
        del made
        give_back()
        return out

    def reply(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")  # answers may depend on who comes first
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                         "reply": pa.array([x.tobytes() for x in answer(table.column("keys").to_pylist())], pa.binary())})

    sent = "chunk long, bucket int, keys binary"
    if extra is None:
        blobs = chunked.groupBy("chunk").applyInArrow(lambda t: send(t), sent)
    else:
        blobs = chunked.groupBy("chunk").cogroup(extra.groupBy("chunk")).applyInArrow(lambda t, r: send(t, r), sent)
    return blobs.groupBy("bucket").applyInArrow(reply, REPLY)


def replies_of(table, step: int | None = None) -> np.ndarray:
    """The bytes of a chunk's replies (those with that number in `step`), in the order of its keys."""
    if step is not None:
        import pyarrow.compute as pc

        table = table.filter(pc.equal(table.column("step"), step))
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    parts = table.column("reply").to_pylist()
    return np.frombuffer(b"".join(parts[i] for i in order), np.uint8)


def shared(parts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each array of values, where another place of any of the arrays has the same value."""
    joined = np.concatenate(parts)
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    same = np.zeros(len(joined) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.zeros(len(joined), np.uint8)
    out[order] = same[1:] | same[:-1]
    at = 0
    for p in parts:
        yield out[at: at + len(p)]
        at += len(p)


def repeated(blobs: list[bytes]) -> Iterator[np.ndarray]:
    """The answer for 32-bit keys: 1 where a key has come more than once."""
    return shared([unplanes(b, np.uint32) for b in blobs])


def repeated_whole(blobs: list[bytes]) -> Iterator[np.ndarray]:
    """The same for 64-bit keys packed by planes()."""
    return shared([unplanes(b, np.uint64) for b in blobs])
