"""Terms in texts and names to nodes. A dictionary is (key, value, ordinal), key normalized. Texts meet terms through an index of
character grams, whatever the size of either, and no loop is nested."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import cut

#: Characters of the longest grams; a shorter term is a gram of its own.
GRAM = 6
#: Grams of terms that every task may hold, 8 bytes each, to leave out others at once.
HELD = 500_000


def _grams(rows: DataFrame, sizes: list[int], held: list[int] | None = None) -> DataFrame:
    """(key, gram): the distinct grams of these numbers of characters of rows (key, text), as hashes of 64 bits; those in held, if it is given. With no
    sizes, those of the size that a term of the text's length has."""

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        some = None if held is None else np.sort(np.array(held, np.int64))
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                hashes = np.zeros(len(codes) + 1, np.uint64)
                for n in range(1, min(len(codes), max(sizes, default=GRAM)) + 1):
                    hashes = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:] + np.uint64(n)
                    if n in (sizes or [min(GRAM, len(codes))]):
                        grams = hashes.view(np.int64)
                        if some is not None:
                            grams = grams[some[np.minimum(np.searchsorted(some, grams), len(some) - 1)] == grams]
                        found.append(np.unique(grams))
                        at.append(np.full(len(found[-1]), i, np.int64))
            joined = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(joined(at)), joined(found)], names=["key", "gram"])

    return rows.mapInArrow(find, f"key {dict(rows.dtypes)['key']}, gram bigint")


def term_hits(texts: DataFrame, terms: DataFrame, least: int = 2, most: int = HELD) -> DataFrame:
    """(doc_id, term) for every term of `least` characters or more inside a text, once each. texts: doc_id, unique, and text; terms: term.

    A term waits at the rarest of its grams, that is the one in the fewest texts; texts that have it are candidates, and are searched for
    the term. A gram that no text has rules its term out.
    """
    t = terms.select("term").where(F.length("term") >= least).distinct()
    sizes = sorted(r["n"] for r in t.select(F.least(F.length("term"), F.lit(GRAM)).alias("n")).distinct().collect() if r["n"])  # GRAM numbers at most
    if not sizes:
        return texts.select("doc_id", F.lit("").alias("term")).limit(0)
    parts = cut(_grams(t.select(F.col("term").alias("key"), F.col("term").alias("text")), []))
    distinct = parts.select("gram").distinct()
    held = [r["gram"] for r in distinct.collect()] if distinct.count() <= most else None
    index = _grams(texts.select(F.col("doc_id").alias("key"), "text"), sizes, held)
    index = cut(index if held is not None else index.join(distinct, "gram", "left_semi"))  # read twice, texts go through Python once
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(often, "gram", "left").groupBy("key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("absent"))
    some = index.join(cut(rarest.where("absent = 0").select(F.col("key").alias("term"), "gram")), "gram").select(F.col("key").alias("doc_id"), "term")
    return some.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("term"))).select("doc_id", "term")


def _either_way(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, key) where one contains the other; neither is empty. names: k; keys: key. Both directions go through the index of term_hits."""
    k, d = names.select("k").where("k <> ''").distinct(), keys.select("key").where("key <> ''").distinct()
    longer = term_hits(d.select(F.col("key").alias("doc_id"), F.col("key").alias("text")), k.select(F.col("k").alias("term")), 1).select(F.col("term").alias("k"), F.col("doc_id").alias("key"))
    shorter = term_hits(k.select(F.col("k").alias("doc_id"), F.col("k").alias("text")), d.select(F.col("key").alias("term")), 1).select(F.col("doc_id").alias("k"), F.col("term").alias("key"))
    return longer.union(shorter).distinct()


def resolve(names: DataFrame, dictionary: DataFrame, norm, partial_from: int = 1) -> DataFrame:
    """names (name, ...) with `resolved`: the value of the exact key, else of the first dictionary key that contains the name
    or that it contains, if it has partial_from characters."""
    keyed = names.select("name").distinct().withColumn("k", norm(F.col("name"))).where("k <> ''")
    d = dictionary.select("key", "value", "ordinal")
    exact = keyed.join(d, keyed["k"] == d["key"], "left").select("name", "k", F.col("value").alias("exact"))
    miss = exact.where(F.col("exact").isNull() & (F.length("k") >= partial_from))
    near = _either_way(miss, d).join(d, "key").groupBy("k").agg(F.min_by("value", "ordinal").alias("near"))
    found = exact.join(near, "k", "left").select("name", F.coalesce("exact", "near").alias("resolved"))
    return names.join(found, "name", "left")


def duplicate_of(names: DataFrame, seeds: DataFrame, norm) -> DataFrame:
    """names (name) with duplicate_of: the first seed (value) whose normalized name contains the name's or is contained in it. An
    empty normalized name is contained in every other."""
    n = names.select("name").distinct().withColumn("k", norm(F.col("name")))
    s = seeds.select(norm(F.col("seed")).alias("key"), "value", "ordinal")
    first = lambda rows: rows.agg(F.min_by(F.struct("value", "ordinal"), "ordinal")).scalar()
    near = _either_way(n, s).join(s, "key").groupBy("k").agg(F.min_by(F.struct("value", "ordinal"), "ordinal").alias("_near"))
    found = n.join(near, "k", "left").select("name", "k", "_near", first(s).alias("_first"), first(s.where("key = ''")).alias("_empty"))
    options = F.array_compact(F.array(F.when(F.col("k") == "", F.col("_first")), F.col("_near"), F.col("_empty")))
    best = F.array_min(F.transform(options, lambda x: F.struct(x["ordinal"].alias("ordinal"), x["value"].alias("value"))))
    return names.join(found.select("name", best["value"].alias("duplicate_of")), "name", "left")


def prioritized(links: DataFrame, new: DataFrame, existing: DataFrame, norm) -> DataFrame:
    """links (name, ...) with kp_id from the new names' index, else from the existing ones'; null is a miss. Indexes: key, value."""
    k = links.withColumn("_k", F.nullif(norm(F.col("name")), F.lit("")))
    n, e = new.select(F.col("key").alias("_k"), F.col("value").alias("_new")), existing.select(F.col("key").alias("_k"), F.col("value").alias("_old"))
    return k.join(n, "_k", "left").join(e, "_k", "left").withColumn("kp_id", F.coalesce("_new", "_old")).drop("_k", "_new", "_old")


def canonical(names: DataFrame, vocabulary: DataFrame, norm) -> DataFrame:
    """names (name) with `canonical`: the vocabulary's spelling of the raw or the normalized name, else as it is."""
    raw = vocabulary.select(F.col("name").alias("_raw"), F.col("name").alias("_exact")).distinct()
    near = vocabulary.groupBy(norm(F.col("name")).alias("_norm")).agg(F.min_by("name", "ordinal").alias("_near"))
    out = names.join(raw, names["name"] == raw["_raw"], "left").drop("_raw").withColumn("_norm", norm(F.col("name"))).join(near, "_norm", "left")
    return out.withColumn("canonical", F.coalesce("_exact", "_near", "name")).drop("_norm", "_exact", "_near")


def found_action(updates: DataFrame, base: DataFrame, key: str, missing: str = "add") -> DataFrame:
    """updates with `action`: update where the key exists in base, else add."""
    known = base.select(F.col(key), F.lit(True).alias("_known")).distinct()
    return updates.join(known, key, "left").withColumn("action", F.when(F.col("_known"), "update").otherwise(missing)).drop("_known")
