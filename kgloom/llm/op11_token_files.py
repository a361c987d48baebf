"""Token ids in binary files: a folder of shards, each document a zstandard frame of its own under one shared dictionary.

encode() gives the ids that the tokenizers library gives: normalization and splitting follow its tables (see op8_bpe), its own
BPE model merges the pieces. write() trains the dictionary on a bounded sample of short documents (SAMPLE_DOCS of SAMPLE_BYTES
at most: a document beyond that gains little from one), sorts by doc_id in ranges and writes one shard a range; read() gives
documents back, all or those of some ids.

The format, all little-endian. `dictionary` holds the trained dictionary, empty where too few documents teach one. A shard is
MAGIC, the width of an id in bytes (one byte), 32 bytes of the dictionary's SHA-256; one frame a document; then the index, that
is the doc_ids (int64), whether each is null (one byte), offsets of the frames and of their end (uint64), counts of ids (uint64);
and at the end the index's offset, the documents, the ids (three uint64) and MAGIC. `manifest.json` names the dictionary and the
shards in order with the number of ids before each. It is written last: without it the folder holds nothing. A retried task
writes a file of another name, so lost executors leave no half shard in the manifest. Files are reached through pyarrow.fs,
so executors reach what the URI of the shared folder names (file, hdfs, s3, gs, abfs).

Null or empty text has only the end id. A null doc_id comes first, as Spark sorts it; equal ids follow each other in the
order of their contents, repeated rows are written as often. Texts of any length are one frame, held by one task at a time. An
empty table gives a folder without shards and an empty result. Other columns are not carried.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import documents, map_texts, quoted, remove, shared_dir, stage
from .op8_bpe import BLOCK, SPLIT, TABLE, TABLE_TEXT, Encoder, byte_symbols, classes, vocabulary

END = 1
#: The dictionary's teachers (twice as many at most), by hashes of their rows, and its size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 4000, 4096, 64 << 10
LEVEL = 3
MAGIC = b"KGTOKEN1"
TAIL = struct.Struct("<QQQ8s")
#: Bytes of frames read at once.
READ = 4 << 20
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


#: White space to str.split() alone.
ODD = "\x1c\x1d\x1e\x1f"


class Kept(dict):
    """A table that asks `make` for what it lacks; make keeps what it wants to."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        return self.make(key)


class LibraryEncoder(Encoder):
    """The op8 encoder with the merges left to the tokenizers library's BPE model, and ids packed as they are kept. Tokens of code points below PLAIN, where
    NFC changes nothing and Python's lower case is the library's, skip the library's normalizers and the classes of all of Unicode. Whole texts of Latin-1
    without special tokens are lower-cased before they are split, so that a word's spellings are one token of the table."""

    PLAIN = 0x250

    def __init__(self, data: str, known: dict[str, str], width: int) -> None:
        from tokenizers import models

        super().__init__(data, known)
        model = json.loads(data)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.model = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"] or "", cache_capacity=0)
        self.symbols, self.code = byte_symbols(), "H" if width == 2 else "I"
        below = [chr(c) for c in range(self.PLAIN)]
        self.other = re.compile(f"[^{below[0]}-{below[-1]}]")
        if any(c.lower() != self.lower.normalize_str(self.nfc.normalize_str(c)) for c in below):
            self.other = re.compile("")  # matches every token
        self.folds = not self.other.search("a")
        split = SPLIT
        for pattern, inside in known.items():
            inside = re.compile(f"[{inside}]")
            split = split.replace(pattern, "".join(re.escape(c) for c in below if inside.match(c)))
        self.split_plain = re.compile(split)
        self.table: dict[str, bytes] = Kept(self.chunk)
        self.packs: dict[str, bytes] = {}

    def merged(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isprintable() else "".join(map(self.symbols.__getitem__, piece.encode()))
        found = array(self.code, [t.id for t in self.model.tokenize(plain)]).tobytes()
        if len(piece) <= TABLE_TEXT:
            if len(self.packs) >= TABLE:
                self.packs.clear()
            self.packs[piece] = found
        return found

    def plain_token(self, chunk: str) -> bytes:
        """Of a token without white space and special tokens."""
        if not (self.folds and chunk.isascii()) and self.other.search(chunk):
            low, split = self.lower.normalize_str(self.nfc.normalize_str(chunk)), self.split
        else:
            low, split = chunk.lower(), self.split_plain
        get, merged = self.packs.get, self.merged
        if self.words and low.isalpha():
            return get(low) or merged(low)
        return b"".join([get(p) or merged(p) for p in split.findall(low)])

    def chunk(self, chunk: str) -> bytes:
        if self.cut and "<" in chunk:
            found = b"".join([array(self.code, [self.special[p]]).tobytes() if p in self.special else self.plain_token(p) for p in self.cut.split(chunk) if p])
        else:
            found = self.plain_token(chunk)
        if len(chunk) <= TABLE_TEXT:
            if len(self.table) >= TABLE:
                self.table.clear()
            self.table[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        return self.white.split(text) if any(c in text for c in ODD) else text.split()

    def packed(self, text: str | None) -> bytes:
        text = text or ""
        if self.folds and not (self.cut and "<" in text):
            with contextlib.suppress(UnicodeEncodeError):
                text.isascii() or text.encode("latin-1")
                text = text.lower()
        return b"".join(map(self.table.__getitem__, self.chunks(text)))


@functools.lru_cache(maxsize=1)
def encoder(data: str, known: str, width: int) -> LibraryEncoder:
    """One a worker, kept from task to task with its bounded tables."""
    return LibraryEncoder(data, json.loads(known), width)


def _start(data: str, known: str, width: int, end: int | None):
    def start():
        one = encoder(data, known, width)
        tail = np.array([] if end is None else [end], f"<u{width}").tobytes()

        def pack(text: str | None) -> tuple:
            ids = one.packed(text) + tail
            return ids, len(ids) // width

        return lambda texts: [pack(t) for t in texts]

    return start


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end: int | None = END) -> tuple[DataFrame, int]:
    """((doc_id, ids, n_ids), width): ids are packed little-endian integers of `width` bytes, with `end` behind them."""
    with open(path, encoding="utf-8") as f:  # on the driver; a vocabulary file, of fixed size
        data = f.read()
    spec = json.loads(data)
    width = 2 if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end or 0]) < 1 << 16 else 4
    given = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), quoted(text).alias("text"))
    make = _start(data, json.dumps(classes()), width, end)
    return map_texts(given, make, T._parse_datatype_string("ids binary, n_ids bigint"), block=BLOCK).drop("text"), width


def train(rows: DataFrame, docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from a bounded sample of rows (ids, _row); empty where they are too few or too alike to teach one."""
    import zstandard

    short = rows.where(F.octet_length("ids") <= SAMPLE_BYTES)
    every = max(1, short.count() // docs)  # then about as many rows as wanted reach the driver, or twice that
    sample = [bytes(r["ids"]) for r in short.where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select("ids").limit(2 * docs).collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _put(uri: str, name: str, data: bytes) -> None:
    files, folder = _files(uri)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/{name}") as out:
        out.write(data)


def _get(uri: str, name: str) -> bytes:
    files, folder = _files(uri)
    with files.open_input_stream(f"{folder}/{name}") as f:
        return f.read()


def _dictionary(uri: str, wanted: str):
    """The folder's dictionary, checked against its hash; None where it is empty."""
    import zstandard

    data = _get(uri, "dictionary")
    if hashlib.sha256(data).hexdigest() != wanted:
        raise ValueError(f"the dictionary of {uri} isn't the one that its shards name")
    return zstandard.ZstdCompressionDict(data) if data else None


@dataclass
class Shard(WriterCommitMessage):
    part: int
    file: str
    n_docs: int
    n_ids: int
    first: int | None
    last: int | None


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.uri, self.width, self.sha = options["path"], int(options["width"]), options["dictionary"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, out = f"part-{part:06d}-{uuid.uuid4().hex}.ids", None
        doc_ids, nulls, offsets, counts = [], bytearray(), [len(MAGIC) + 33], []
        files, folder = _files(self.uri)
        given = _dictionary(self.uri, self.sha)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_dict_id=False)
        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{folder}/{name}")
                    out.write(MAGIC + bytes([self.width]) + bytes.fromhex(self.sha))
                raw = ids.as_buffer()
                frame = pack.compress(raw)
                out.write(frame)
                doc_ids.append(doc_id.as_py())
                nulls.append(doc_ids[-1] is None)
                offsets.append(offsets[-1] + len(frame))
                counts.append(len(raw) // self.width)
        if out is None:
            return Shard(part, "", 0, 0, None, None)
        for x in (np.array([i or 0 for i in doc_ids], "<i8"), np.frombuffer(nulls, "u1"), np.array(offsets, "<u8"), np.array(counts, "<u8")):
            out.write(x.tobytes())
        out.write(TAIL.pack(offsets[-1], len(counts), sum(counts), MAGIC))
        out.close()
        known = [i for i in doc_ids if i is not None]
        return Shard(part, name, len(counts), sum(counts), min(known, default=None), max(known, default=None))

    def commit(self, messages: list) -> None:
        shards, start = [], 0
        for m in sorted((m for m in messages if m and m.n_docs), key=lambda m: m.part):
            shards.append({"file": m.file, "n_docs": m.n_docs, "n_ids": m.n_ids, "start": start, "first": m.first, "last": m.last})
            start += m.n_ids
        _put(self.uri, "manifest.json", json.dumps({"width": self.width, "dictionary": self.sha, "n_ids": start, "shards": shards}).encode())

    def abort(self, messages: list) -> None:
        files, folder = _files(self.uri)
        for m in messages:
            if m and m.n_docs:
                files.delete_file(f"{folder}/{m.file}")


class Reader(DataSourceReader):
    """Partitions are shards. Option `ids` (comma-joined) reads the frames of those documents only."""

    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.ids = sorted(map(int, options["ids"].split(","))) if options.get("ids") else None

    def partitions(self) -> list[InputPartition]:
        manifest = json.loads(_get(self.uri, "manifest.json"))
        shards = [s for s in manifest["shards"] if self.ids is None or (s["first"] is not None and any(s["first"] <= i <= s["last"] for i in self.ids))]
        return [InputPartition((manifest["width"], manifest["dictionary"], s["file"], s["start"])) for s in shards] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import zstandard

        if partition.value is None:
            return
        width, sha, name, base = partition.value
        files, folder = _files(self.uri)
        given = _dictionary(self.uri, sha)
        unpack = zstandard.ZstdDecompressor(dict_data=given) if given else zstandard.ZstdDecompressor()
        with files.open_input_file(f"{folder}/{name}") as f:
            head, tail = f.read_at(len(MAGIC) + 33, 0), f.read_at(TAIL.size, f.size() - TAIL.size)
            at, n, _, magic = TAIL.unpack(tail)
            if magic != MAGIC or head != MAGIC + bytes([width]) + bytes.fromhex(sha):
                raise ValueError(f"{name} isn't a shard of this folder")
            index = f.read_at(f.size() - TAIL.size - at, at)
            doc_ids, nulls = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n).astype(bool)
            offsets, counts = np.frombuffer(index, "<u8", n + 1, 9 * n).astype("i8"), np.frombuffer(index, "<u8", n, 17 * n + 8).astype("i8")
            starts = base + np.cumsum(counts) - counts
            wanted = np.arange(n) if self.ids is None else np.flatnonzero(np.isin(doc_ids, self.ids) & ~nulls)
            lo = 0
            while lo < len(wanted):  # neighbouring frames, READ bytes or one document at a time
                hi = lo + 1
                while hi < len(wanted) and wanted[hi] == wanted[hi - 1] + 1 and offsets[wanted[hi] + 1] - offsets[wanted[lo]] <= READ:
                    hi += 1
                rows = wanted[lo:hi]
                data = memoryview(f.read_at(int(offsets[rows[-1] + 1] - offsets[rows[0]]), int(offsets[rows[0]])))
                ids = [np.frombuffer(unpack.decompress(data[int(offsets[r] - offsets[rows[0]]): int(offsets[r + 1] - offsets[rows[0]])]), f"<u{width}").astype("<u4") for r in rows]
                if [len(x) for x in ids] != counts[rows].tolist():
                    raise ValueError(f"{name}: a frame holds another number of ids than its index says")
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids[rows], mask=nulls[rows]), pa.array(starts[rows]), pa.array(counts[rows]), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])
                lo = hi


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options)


def write(rows: DataFrame, width: int, path: str) -> None:
    """Writes rows (doc_id, ids) as a new folder `path`, in ascending order of doc_id."""
    rows.sparkSession.dataSource.register(TokenFiles)
    staged = stage(rows.select("doc_id", "ids").withColumn("_tie", F.xxhash64("ids")).withColumn("_row", F.monotonically_increasing_id()))
    data = train(staged)
    _put(path, "dictionary", data)
    order = ["doc_id", "_tie", "_row"]  # many rows of one id go to several ranges
    ranged = staged.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    ranged.write.format("token_files").mode("append").option("width", width).option("dictionary", hashlib.sha256(data).hexdigest()).save(path)
    remove(staged)


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a folder: start counts the ids of all documents before, ids are 32-bit integers packed."""
    spark.dataSource.register(TokenFiles)
    found = spark.read.format("token_files")
    return (found if ids is None else found.option("ids", ",".join(map(str, ids)) or "-1")).load(path)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, width = encode(documents(spark, sf_dir), vocabulary())
    path = f"{shared_dir(spark)}/kgloom-token-files/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write(rows, width, path)
    back = read(spark, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
