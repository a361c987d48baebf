"""BPE encoding and decoding over a contiguous array of ranks.

A short word holds its part boundaries and the rank of each adjacent pair in plain arrays: scan for the least rank,
delete the boundary behind it, refresh the two neighbouring ranks, until no pair has a rank. Words beyond LONG_WORD
symbols use a heap with the same order (least rank, then leftmost), so that one endless word isn't quadratic.

The vocabulary is read once, on the driver, from a path that is a parameter, and travels with the function: its size is
that of the file. Normalization and splitting are those of SETTINGS (NFC, white space, lower case, letters, single digits,
runs of other characters); a file with other settings is refused. What is a letter, a number or white space, and what
NFC and lower case give, follows the Unicode tables of the tokenizers library, which differ from Python's in new code
points: the driver asks the library for its classes. Pieces never span white space, so results are kept per white-space
token in a bounded table.

Null or empty text has no tokens, and decodes to the empty text. Texts of any length go in blocks of about BLOCK bytes, one
text at least; ids leave as 32-bit Arrow lists. Repeated rows are encoded alike. An empty table gives an
empty result. Columns that clash with the results give way.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, map_texts

LONG_WORD = 256
#: Tokens kept in a worker's table, and as many pieces of them, and the longest text of one: some 100 MB at most.
TABLE, TABLE_TEXT = 300_000, 64
#: Bytes of text that a worker holds at a time, about.
BLOCK = 1 << 20

#: The settings that this encoder follows, as the vocabulary file states them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "decoder": None,
}
MODEL_SETTINGS = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED_SETTINGS = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


@functools.cache
def char_class(pattern: str) -> str:
    """The code points that the tokenizers library takes for `pattern`, as the inside of a character class."""
    from tokenizers import Regex, normalizers

    drop, found = normalizers.Replace(Regex(pattern), ""), []
    for lo in range(0, 0x110000, 1 << 14):
        block = [chr(c) for c in range(lo, lo + (1 << 14)) if not 0xD800 <= c < 0xE000]
        left = set(drop.normalize_str("".join(block)))
        found += [ord(c) for c in block if c not in left]
    ends = [i for i in range(len(found)) if i + 1 == len(found) or found[i + 1] != found[i] + 1]
    runs = [(found[lo], found[hi]) for lo, hi in zip([0, *(i + 1 for i in ends[:-1])], ends, strict=True)]
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in runs)


def classes() -> dict[str, str]:
    return {p: char_class(p) for p in (r"\p{L}", r"\p{N}", r"\s")}


def letters_agree(letters: str) -> bool:
    """Whether what Python takes for letters lies within a class: then a word of them needs no splitting."""
    inside = re.compile("[" + letters + "]")
    return all(inside.match(c) for c in map(chr, range(0x110000)) if c.isalpha())


def checked(spec: dict) -> dict:
    """The file's content; raises where it asks for what this encoder doesn't do."""
    for part, given, wanted in (("", spec, SETTINGS), ("model.", spec["model"], MODEL_SETTINGS), *(("added_tokens.", t, ADDED_SETTINGS) for t in spec["added_tokens"])):
        for key, value in wanted.items():
            if given.get(key) != value:
                raise ValueError(f"vocabulary setting {part}{key} is {given.get(key)!r}, not {value!r}")
    return spec


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Encoder:
    def __init__(self, data: str, known: dict[str, str] | None = None) -> None:
        import regex
        from tokenizers import normalizers

        spec = checked(json.loads(data))
        known = known or classes()
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        # (left id, right id) -> (rank, id of the pair)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.texts = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        symbols = byte_symbols()
        self.first = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.end] for s in symbols]
        split = SPLIT
        for pattern, inside in known.items():
            split = split.replace(pattern, inside)
        self.split = regex.compile(split)
        self.split_ascii = re.compile(SPLIT.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "))  # of lower case
        self.words = letters_agree(known[r"\p{L}"])
        self.nfc, self.lower = normalizers.NFC(), normalizers.Lowercase()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.white = regex.compile("[" + known[r"\s"] + "]+")
        self.odd = regex.compile("[\x1c-\x1f]")  # white space to str.split() alone
        self.table: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self.merge_long(parts) if len(parts) > LONG_WORD else self.merge_short(parts)

    def merge_short(self, parts: list[int]) -> list[int]:
        pairs, none = self.pairs, (1 << 60, -1)
        ranks = [pairs.get((parts[i], parts[i + 1]), none) for i in range(len(parts) - 1)]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == none[0]:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*p, i, parts[i], parts[i + 1]) for i in range(n - 1) if (p := self.pairs.get((parts[i], parts[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (p := self.pairs.get((parts[i], parts[j]))):
                heapq.heappush(heap, (p[0], i, p[1], parts[i], parts[j]))

        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def plain(self, chunk: str) -> list[int]:
        """Of text without white space and special tokens."""
        low = chunk.lower() if chunk.isascii() else self.lower.normalize_str(self.nfc.normalize_str(chunk))
        if self.words and low.isalpha():
            return self.piece(low)
        out: list[int] = []
        for piece in (self.split_ascii if low.isascii() else self.split).findall(low):
            out += self.piece(piece)
        return out

    def piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            found = self.merge(piece.encode())
            if len(piece) <= TABLE_TEXT:
                if len(self.pieces) >= TABLE:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        """Ids, as 32-bit integers, of a token without white space; short ones are kept."""
        ids: list[int] = []
        for part in self.cut.split(chunk) if self.cut and "<" in chunk else [chunk]:
            if part:
                ids += [self.special[part]] if part in self.special else self.plain(part)
        found = array("I", ids).tobytes()
        if len(chunk) <= TABLE_TEXT:
            if len(self.table) >= TABLE:
                self.table.clear()
            self.table[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        return self.white.split(text) if self.odd.search(text) else text.split()

    def packed(self, text: str | None) -> bytes:
        known, chunk = self.table.get, self.chunk
        return b"".join([known(c) or chunk(c) for c in self.chunks(text or "")])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        return " ".join(map(self.texts.__getitem__, ids))


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
IDS, DECODED = "token_ids array<int>, ", "decoded string, "


def make(data: str, ids: bool, decoded: bool) -> Callable[[], Callable[[list], list[tuple]]]:
    known = classes()

    def start():
        encoder = Encoder(data, known)

        def one(text: str | None) -> tuple:
            packed = encoder.packed(text)
            numbers = np.frombuffer(packed, "<i4")
            plain = encoder.decode(numbers.tolist())
            digests = len(numbers), hashlib.sha256(packed).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()
            return (*([numbers] if ids else []), *([plain] if decoded else []), *digests)

        return lambda texts: [one(t) for t in texts]

    return start


def encode(docs: DataFrame, path: str, text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """docs with token_ids (array of int) if ids, decoded (text) if decoded, and the digests of both. What isn't asked for doesn't
    leave the worker."""
    with open(path, encoding="utf-8") as f:  # on the driver; a vocabulary file, of fixed size
        data = f.read()
    return map_texts(docs, make(data, ids, decoded), T._parse_datatype_string(IDS * ids + DECODED * decoded + DIGESTS), text, BLOCK)


def digest(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and the digests only."""
    return encode(docs, path, text, ids=False, decoded=False)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir).select("doc_id", "text"), vocabulary()).drop("text")
