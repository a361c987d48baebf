"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the 10-word windows of the benchmark items (an item of fewer words is one window), as sequences of word
numbers. For each window length, a shift table over blocks of two words tells how far the search may jump; only where
the shift is 0 does the suffix block's bucket offer windows, the first block rules most of them out, and a direct
comparison confirms the rest. Words that no item has share number 0, which is in no block, so clean text is passed in
full strides.

The tables are built from the benchmark, which is small beside the documents; its size is checked: beyond MAX_WINDOWS
windows the items go in several blocks, each a pass of its own over the documents with tables of bounded size, staged in
between. Documents are never shuffled.

Null text has no words. Rows of the benchmark without words give no window; rows that repeat a window or an id count as
what they are: an item is hit if any of its windows occurs, ids count once, and a null id counts as the empty one. An empty benchmark contaminates nothing.
Columns that clash with the results give way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_texts, others, quoted, stage

WINDOW = 10
#: Windows whose tables one pass holds; about 1 KB each in a worker.
MAX_WINDOWS = 100_000
#: Of lower-cased UTF-8: ASCII letters and digits, and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []  # bytes.lower() takes A-Z only


class Search:
    """Wu-Manber for sequences of one length."""

    def __init__(self, size: int, patterns: dict[tuple[int, ...], list[str]]) -> None:
        self.size, self.block = size, min(2, size)
        self.far = size - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, tuple[int, ...], list[str]]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, size + 1):
                key = self.key(p, end)
                self.shift[key] = min(self.shift.get(key, self.far), size - end)
            self.bucket.setdefault(self.key(p, size), []).append((self.key(p, self.block), p, items))

    def key(self, ids, end: int) -> int:
        return ids[end - 1] if self.block == 1 else ids[end - 2] << 32 | ids[end - 1]

    def occurrences(self, ids: list[int]) -> Iterable[tuple[int, list[str]]]:
        size, far, shift, bucket, key, n = self.size, self.far, self.shift, self.bucket, self.key, len(ids)
        end = size
        while end <= n:
            k = key(ids, end)
            step = shift.get(k, far)
            if step:
                end += step
                continue
            start = end - size
            head = key(ids, start + self.block)
            for first, pattern, items in bucket[k]:
                if first == head and tuple(ids[start:end]) == pattern:
                    yield start, items
            end += 1


class Matcher:
    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, ws in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in ws]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners = by_size.setdefault(size, {}).setdefault(tuple(ids[i:i + size]), [])
                if item not in owners:
                    owners.append(item)
        self.searches = [Search(size, p) for size, p in sorted(by_size.items())]

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged word spans, items) with an occurring window."""
        get, spans, items = self.numbers.get, [], set()
        ids = [get(w, 0) for w in ws]
        for search in self.searches:
            for start, owners in search.occurrences(ids):
                spans.append((start, start + search.size))
                items.update(owners)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def make(items: list[tuple[str, list[bytes]]], window: int) -> Callable[[], Callable[[list], list[tuple]]]:
    def start():
        matcher = Matcher(items, window)

        def work(texts: list) -> list[tuple]:
            out = []
            for text in texts:
                ws = words(text)
                spans, found = matcher.find(ws)
                out.append((len(ws), [list(s) for s in spans], sorted(found)))
            return out

        return work

    return start


FOUND = "n_words bigint, hit_spans array<array<bigint>>, hit_items array<string>"



def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, hit_spans (maximal word ranges [from, to)) and hit_items (ids as strings, sorted)."""
    given = docs.select(*[quoted(c) for c in others(docs, ["n_words", "hit_spans", "hit_items", "_spans", "_items"])])
    picked = benchmark.select(quoted(item_id).cast("string").alias("i"), quoted(item_text).alias("t")).where("t is not null")
    windows = picked.agg(F.sum(F.size(F.split("t", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))).alias("n")).first()["n"] or 0
    passes = max(1, -(-windows // max_windows))
    out = given
    for k in range(passes):
        part = picked if passes == 1 else picked.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        items = [(r["i"] or "", words(r["t"])) for r in part.collect()]  # about max_windows words
        if not k:
            out = map_texts(given, make(items, window), T._parse_datatype_string(FOUND), text)
        else:
            out = stage(out.withColumnsRenamed({"hit_spans": "_spans", "hit_items": "_items"}))
            out = map_texts(out, make(items, window), T._parse_datatype_string(FOUND), text)
            out = out.withColumn("hit_items", F.array_sort(F.array_distinct(F.concat("_items", "hit_items")))).withColumn(
                "hit_spans", _merge_spans(F.concat("_spans", "hit_spans"))).drop("_spans", "_items")
    return out


def _merge_spans(spans):
    """Merged ranges of an array of ranges."""
    empty = F.array().cast("array<array<bigint>>")
    return F.aggregate(F.array_sort(spans), empty, lambda a, s: F.when(
        (F.size(a) > 0) & (F.get(s, 0) <= F.get(F.element_at(a, -1), 1)),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array(F.get(F.element_at(a, -1), 0), F.greatest(F.get(F.element_at(a, -1), 1), F.get(s, 1)))))
    ).otherwise(F.concat(a, F.array(s))))


def measure(found: DataFrame) -> DataFrame:
    """found with n_hit, n_items, items_sha256 and contaminated instead of spans and items."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + F.get(s, 1) - F.get(s, 0))
    keep = others(found, ["n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "hit_items"])
    return found.select(*[quoted(c) for c in keep], n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_items") > 0).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return measure(find(documents(spark, sf_dir).select("doc_id", "text"), benchmark)).drop("text")
