"""Line dedup by a suffix array over line sequences, built by distributed prefix doubling, in DataFrame expressions only.

A document is the sequence of its lines that have a word, and each place in it starts a suffix.

1. Ranks. Suffixes are ranked by their first line, then by 2, 4, ... lines: the rank at twice the depth orders the pairs of
   ranks that lie a depth apart. Pairs are sorted by range over all tasks, so ranks are the order of the suffix array
   at that depth. A suffix whose rank no other shares, or that ends within the depth, is settled and leaves; the rounds go on until
   all have. A depth of min_lines is one of the rounds (the step to it may overlap).
2. Intervals. Suffixes that still share a rank after a round are an interval of the array whose longest common prefix
   has at least that many lines. A place's source is the first place (least id, then least position) of the deepest such interval in
   which the place isn't first itself.
3. Longest common prefixes. Neighbouring places whose sources are neighbours too are one run. How far its last place and that
   place's source agree is told exactly by going down the ranks of the rounds that were kept: what is common so far is passed over
   on both sides, and equal ranks there add that round's depth. So a run has a start, a source and an exact length in lines.
4. Deletion. Runs of min_lines lines or more go at their later places, all of them; overlapping runs join to maximal
   ones. lcp_lines tells the longest run that a document copies from its source, in lines.

Hot lines: an interval's size and first place come from a grouped aggregation with partial sums; they meet their places in
an equi-join with nothing above it in its stage, so that skewed keys are split; no window or group gathers all places of
a line. Windows hold the places of one document. Every round is staged; the rounds are deleted once the runs are known. Texts are
shuffled once, to meet their deletions.

Lines without a word (blank ones) never count and stay. Null text has no lines and stays null. Null ids stand after all
others; ids are integers. Rows with equal ids have equal places: neither is earlier, both keep a run that starts at the same
line. Repeated rows are treated alike. A text of any length is one array of its lines in one row. An empty table gives an empty
result. Columns that clash with the results give way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, others, quoted, remove, stage
from .op1_quality import let

#: Shortest run that counts.
MIN_LINES = 1
HAS_WORD = r"[^\x20\x09-\x0D]"
DOC = ["none", "id", "text_hash"]


def lines_of(text: Column) -> Column:
    """The lines with a word as structs (pos: their number among all lines, line)."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))),
                    lambda x: F.regexp_like(x["line"], F.lit(HAS_WORD)))


def _ranked(places: DataFrame, key: list[str]) -> DataFrame:
    """Places (DOC, idx) whose key isn't theirs alone, with its rank and first place (none, id, idx, text_hash); staged."""
    first = F.min(F.struct("none", "id", "idx", "text_hash")).alias("first")
    groups = places.groupBy(*key).agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    order = stage(groups.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("new", F.monotonically_increasing_id()))
    out = stage(places.join(order, key).select(*DOC, "idx", F.col("new").alias("rank"), "first"))
    remove(order)
    return out


def intervals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """The rounds as (depth, places in intervals), places (DOC, idx, rank, first) staged; the last has none. idx counts the lines with a word."""
    hashes = F.transform(lines_of(quoted(text)), lambda x: F.struct(F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b")))
    rows = docs.where(quoted(text).isNotNull()).select(
        quoted(doc_id).isNull().alias("none"), F.coalesce(quoted(doc_id).cast("long"), F.lit(0)).alias("id"), F.xxhash64(quoted(text)).alias("text_hash"), F.posexplode(hashes).alias("idx", "h"))
    places, depth = _ranked(rows.select(*DOC, "idx", F.col("h.a").alias("a"), F.col("h.b").alias("b")).distinct(), ["a", "b"]), 1
    rounds = [(depth, places)]
    while not places.isEmpty():
        step = depth if depth >= min_lines else min(depth, min_lines - depth)
        ahead = places.select(*DOC, (F.col("idx") - step).alias("idx"), F.col("rank").alias("next"))
        places, depth = _ranked(places.drop("first").join(ahead, [*DOC, "idx"]), ["rank", "next"]), depth + step
        rounds.append((depth, places))
    return rounds


def _agreed(runs: DataFrame, depth: int, places: DataFrame) -> DataFrame:
    """Runs that are longer by depth where what follows on both sides has the same rank at that depth; staged."""
    place = lambda at, rank: places.select(*[F.col(c).alias(f"{at}_{c}") for c in [*DOC, "idx"]], F.col("rank").alias(rank))
    here = [F.col(c) == F.col(f"a_{c}") for c in DOC] + [F.col("idx") + F.col("length") == F.col("a_idx")]
    there = [F.col(f"first.{c}") == F.col(f"b_{c}") for c in DOC] + [F.col("first.idx") + F.col("length") == F.col("b_idx")]
    met = runs.join(place("a", "mine"), here, "left").select(*runs.columns, "mine").join(place("b", "its"), there, "left")
    longer = F.when(F.col("mine") == F.col("its"), depth).otherwise(0)
    return stage(met.select(*DOC, "idx", (F.col("length") + longer).alias("length"), "first", "depth"))


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(DOC, idx, length, first): runs of at least min_lines lines with a word, from idx on, that stand earlier too, from first on; staged."""
    rounds = intervals(docs, doc_id, text, min_lines)
    later = reduce(DataFrame.union, [
        p.where(F.struct("none", "id", "idx") > F.struct("first.none", "first.id", "first.idx")).select(*DOC, "idx", F.lit(d).alias("depth"), "first")
        for d, p in rounds if d >= min_lines or p is rounds[-1][1]])
    # dealt by document once: the deepest interval of a place, the windows and the runs need no exchange after it
    deepest = later.repartition(*DOC).groupBy(*DOC, "idx").agg(F.max(F.struct("depth", "first")).alias("m")).select(*DOC, "idx", "m.depth", "m.first")
    line = Window.partitionBy(*DOC).orderBy("idx")
    way = F.struct("first.none", "first.id", "first.text_hash", F.col("first.idx") - F.col("idx"))
    new = ~((F.lag("idx").over(line) == F.col("idx") - 1) & (F.lag("way").over(line) == F.col("way")))
    numbered = deepest.withColumn("way", way).withColumn("new", F.coalesce(new, F.lit(True))).withColumn("run", F.count_if("new").over(line))
    found = numbered.groupBy(*DOC, "run").agg(F.min("idx").alias("start"), F.max("idx").alias("last"), F.max_by("depth", "idx").alias("depth"), F.min_by("first", "idx").alias("first"))
    made = stage(found.select(*DOC, F.col("start").alias("idx"), (F.col("last") - F.col("start") + F.col("depth")).alias("length"), "first", "depth"))
    # a place and its source agree on less than the next round's depth, so each round below adds its depth once or not at all
    out, most = None, made.agg(F.max("depth")).first()[0] or 0
    for (d, places), (above, _) in zip(rounds[-2::-1], rounds[:0:-1], strict=True):
        if above <= most:
            entering = made.where(F.col("depth") == above)
            past, out = out, _agreed(entering if out is None else out.union(entering), d, places)
            if past is not None:
                remove(past)
    for _, places in rounds:
        remove(places)
    settled = made.where(F.col("depth") == 1)
    return (settled if out is None else out.union(settled)).drop("depth")


def _gone(docs: DataFrame, doc_id: str, text: str, min_lines: int) -> DataFrame:
    """(DOC, gone, lcp_lines): numbers among the lines with a word that go, for documents that lose some."""
    found = runs(docs, doc_id, text, min_lines).select(*DOC, "idx", (F.col("idx") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*DOC).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("lo", F.greatest("idx", before))  # each line once, however many runs cover it
    spans = F.collect_list(F.when(F.col("lo") < F.col("end"), F.struct("lo", "end")))
    got = fresh.groupBy(*DOC).agg(spans.alias("spans"), F.max(F.col("end") - F.col("idx")).alias("lcp_lines"))
    return got.select(*DOC, F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["end"] - 1))).alias("gone"), "lcp_lines")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with kept_text, n_lines (with a word), n_removed and lcp_lines."""
    given = docs.select(*[quoted(c) for c in others(docs, ["kept_text", "n_lines", "n_removed", "lcp_lines", "_none", "_id", "_hash", "_gone", "_lcp"])])
    gone = _gone(given, doc_id, text, min_lines).select(
        F.col("none").alias("_none"), F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("gone").alias("_gone"), F.col("lcp_lines").alias("_lcp"))
    keyed = given.select("*", quoted(doc_id).isNull().alias("_none"), F.coalesce(quoted(doc_id).cast("long"), F.lit(0)).alias("_id"), F.xxhash64(quoted(text)).alias("_hash"))
    met = keyed.join(gone, ["_none", "_id", "_hash"], "left")
    worded = lines_of(quoted(text))
    kept = let(F.split(quoted(text), "\n"), lambda all_lines: let(worded, lambda w: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.transform(F.col("_gone"), lambda i: F.get(w, i)["pos"])),
        lambda i: F.get(all_lines, i)), "\n")))
    return met.select(*[quoted(c) for c in given.columns], F.when(F.col("_gone").isNull(), quoted(text)).otherwise(kept).alias("kept_text"),
                      F.coalesce(F.size(worded), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_lcp", F.lit(0)).cast("long").alias("lcp_lines"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "lcp_lines", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
seqs AS (SELECT doc_id, list(md5(line) ORDER BY idx) AS ls FROM worded GROUP BY doc_id),
depths AS (SELECT (1 << k)::BIGINT AS depth FROM (SELECT unnest(range(24)) AS k)),
runs AS (
  SELECT doc_id, depth, idx, md5(array_to_string(list_slice(ls, idx, idx + depth - 1), ' ')) AS run
  FROM (SELECT doc_id, ls, depth, unnest(range(1, len(ls) - depth + 2)) AS idx FROM seqs, depths WHERE depth <= len(ls))),
later AS (
  SELECT doc_id, depth, idx, source FROM (SELECT doc_id, depth, idx, min({'d': doc_id, 'i': idx}) OVER (PARTITION BY depth, run) AS source FROM runs)
  WHERE {'d': doc_id, 'i': idx} > source),
sources AS (SELECT doc_id, idx, arg_max(source, depth) AS source FROM later GROUP BY doc_id, idx),
agreed AS (
  SELECT s.doc_id, list_position(list_append(list_transform(range(least(len(a.ls) - s.idx, len(b.ls) - s.source.i) + 1), lambda t: a.ls[s.idx + t] <> b.ls[s.source.i + t]), true), true) - 1 AS lcp
  FROM sources s JOIN seqs a ON a.doc_id = s.doc_id JOIN seqs b ON b.doc_id = s.source.d),
deepest AS (SELECT doc_id, max(lcp) AS lcp FROM agreed GROUP BY doc_id),
told AS (
  SELECT s.doc_id, count(w.idx) AS n_lines, count(l.idx) AS n_removed, string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (l.idx IS NULL) AS kept
  FROM split s LEFT JOIN worded w ON s.doc_id = w.doc_id AND s.pos = w.pos LEFT JOIN later l ON l.doc_id = w.doc_id AND l.idx = w.idx AND l.depth = 1
  GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(p.lcp, 0)::BIGINT AS lcp_lines,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id LEFT JOIN deepest p ON d.doc_id = p.doc_id
"""
