"""Order-aware dedup, dictionaries and sequences. `ord` is the input's order; nothing relies on a table's own."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import jaccard_chars, norm_name

FUSED_KEY = ["subject_id", "predicate", "object_id", "source", "section_key"]
RULE_KEY = ["subject_id", "predicate", "object_id", "object_name", "section_key"]


def last_wins(rows: DataFrame, key: list[str], ord_: str = "ord") -> DataFrame:
    """One row a key: the last one's values at the first one's place (`first_ord`). Null keys are equal."""
    rest = [c for c in rows.columns if c not in key]
    g = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(ord_)).alias("_last"), F.min(ord_).alias("first_ord"))
    return g.select(*key, "_last.*", "first_ord")


def dedup_fused(rows: DataFrame) -> DataFrame:
    """Last row wins; sorted by the text of the first three keys, null as `None`."""
    out = last_wins(rows, FUSED_KEY).drop("first_ord")
    return out.orderBy(*[F.coalesce(F.col(k), F.lit("None")) for k in FUSED_KEY[:3]], *[F.col(k).asc_nulls_first() for k in FUSED_KEY[3:]])


def dedup_rules(rows: DataFrame) -> DataFrame:
    """Last row wins, in the order of first places."""
    return last_wins(rows, RULE_KEY).orderBy("first_ord")


def dictionary(terms: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, ordinal): the value last written, at the place the key first had. terms: key, value, ord."""
    return terms.groupBy(key).agg(F.max_by(value, "ord").alias(value), F.min("ord").alias("ordinal"))


def longest_term(hits: DataFrame) -> DataFrame:
    """The longest term of each section and node, the first on ties. hits: section_key, kp_id, term, ord."""
    return hits.groupBy("section_key", "kp_id").agg(F.max_by("term", F.struct(F.length("term"), -F.col("ord"))).alias("term"))


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n) of every column by itself, in one pass over grouping sets, the most frequent value of a dimension first."""
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sets = text.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    bit = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}  # the set that keeps c alone
    pick = lambda of: F.coalesce(*[F.when(F.col("g") == bit[c], of(c)) for c in columns])
    return sets.select(pick(F.lit).alias("dimension"), pick(F.col).alias("value"), "n").orderBy("dimension", F.col("n").desc(), "value")


def upsert_entities(parts: list[DataFrame], key: str = "entity_id") -> DataFrame:
    """Entities of several sources; later sources, then later rows, win. Each part has ord."""
    every = None
    for rank, part in enumerate(parts):
        part = part.withColumn("_rank", F.lit(rank))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "_rank", "ord")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_rank", "ord")).alias("_last")).select(key, "_last.*")


def near_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), both ways: ids of sets of a section that are nearer than the threshold. sets: section_key, id, cs (distinct sets of characters).

    Two near sets differ in d characters at most, d by the size of the smaller one. With characters dealt to d + 2 parts they agree in two parts at
    least, so they meet under the contents of a pair of parts: few others do, where a character alone is shared by most of a section.
    """
    t = Fraction(str(threshold))
    if not 0 < t < 1:
        raise ValueError("a threshold is above 0 and below 1")
    k = F.size("cs")
    differ = lambda n: F.floor((n * (t.denominator - t.numerator) - 1) / t.numerator).cast("int")
    levels = F.array_distinct(F.transform(F.sequence(F.floor(k * t.numerator / t.denominator).cast("int") + 1, k), differ))  # of sets of its size and smaller ones
    dealt = sets.where(k > 0).select("section_key", "id", "cs", F.explode(levels).alias("d"))
    part = lambda i: F.array_join(F.filter("cs", lambda c: F.pmod(F.xxhash64(c), F.col("d") + 2) == i), "")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.transform(F.sequence(i + 1, F.col("d") + 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("parts", i).alias("p"), F.get("parts", j).alias("q")))))
    keyed = dealt.withColumn("parts", F.transform(F.sequence(F.lit(0), F.col("d") + 1), part)).select("section_key", "d", F.explode(pairs).alias("key"), F.col("id").alias("a"), F.col("cs").alias("x"))
    met = keyed.join(keyed.select("section_key", "d", "key", F.col("a").alias("b"), F.col("x").alias("y")), ["section_key", "d", "key"]).where("a <> b")
    common = F.size(F.array_intersect("x", "y"))
    return met.where(common.cast("double") / (F.size("x") + F.size("y") - common) > threshold).select("a", "b").distinct()


def greedy(rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """rows (ord, section_key, name) less those whose normalized name was kept before, or that are nearer than the threshold to
    a name kept in their section before. ord is unique.

    What is kept is the first maximal independent set of a graph, in the rows' order: in rounds, every open row that no open row before
    it bears on is kept, and what a kept row bears on goes. Of the rows of a section with one name only the first can be
    kept. Rows with one name in several sections bear on each other through the least open place of the name. Names of a section with the same
    characters are one class, and near classes bear on each other through their least open places; so neither the names of a class nor those of
    near classes are paired, no task sees a family of names whole, and rounds grow with the longest chain of decisions only.
    """
    from ..plans.staging import cut, drop

    section = F.struct(F.coalesce(F.col("section_key").cast("string"), F.lit("")).alias("key"), F.col("section_key").isNull().alias("none"))  # no section is one too
    n = rows.select("ord", section.alias("section_key"), norm_name(F.col("name")).alias("x"))
    chars = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("x"), ""), lambda c: c != "")))
    places = cut(n.groupBy("section_key", "x").agg(F.min("ord").alias("at")).withColumn("cs", chars))
    classes = cut(places.groupBy("section_key", "cs").agg(F.min("at").alias("id")))
    left = cut(places.join(classes, ["section_key", "cs"]).select("x", "at", "id"))
    near = cut(near_sets(classes, threshold))
    kept = None
    while not left.isEmpty():
        first = left.groupBy("id").agg(F.min("at").alias("at"))
        bar = near.join(first.select(F.col("id").alias("a"), "at"), "a").groupBy(F.col("b").alias("id")).agg(F.min("at").alias("bar"))
        free = first.join(bar, "id", "left").where("bar is null or at < bar").select("id", "at")
        now = cut(left.join(left.groupBy("x").agg(F.min("at").alias("at")), ["x", "at"], "left_semi").join(free, ["id", "at"], "left_semi").select("x", "at", "id"))
        kept = now.select("at") if kept is None else kept.unionAll(now.select("at"))
        gone = near.join(now.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).unionAll(now.select("id"))
        rest = left.join(now.select("x"), "x", "left_anti").join(gone, "id", "left_anti").select("x", "at", "id")
        old, left = left, cut(rest)
        drop(old)
        ends = lambda end: left.select(F.col("id").alias(end))  # noqa: B023, E731
        old, near = near, cut(near.join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi").select("a", "b"))
        drop(old)
    if kept is None:
        return rows.limit(0)
    return rows.join(kept.select(F.col("at").alias("ord")), "ord", "left_semi").select(*rows.columns)


#: Names of a list that every other name is compared with; a longer list meets them through its characters.
MAX_LIST = 2000


def name_overlaps(a: DataFrame, b: DataFrame, most: int = MAX_LIST) -> DataFrame:
    """(a, b, similarity) of distinct names a and b that share a character; a short list b is broadcast."""
    if b.limit(most + 1).count() <= most:
        return a.join(F.broadcast(b)).select("a", "b", jaccard_chars(F.col("a"), F.col("b")).alias("similarity")).where("similarity > 0")
    chars = lambda df, name: df.select(name, F.array_distinct(F.filter(F.split(F.lower(name), ""), lambda c: c != "")).alias("cs")).select(name, F.size("cs").alias(f"n_{name}"), F.explode("cs").alias("c"))
    both = chars(a, "a").join(chars(b, "b"), "c").groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("similarity"))


def near_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity) of names of `left` and of a dictionary `right` with a character Jaccard of threshold, over 0, or more."""
    return name_overlaps(left.select(F.col("name").alias("a")).distinct(), right.select(F.col("name").alias("b")).distinct()).where(F.col("similarity") >= threshold)


def sequence_ids(rows: DataFrame, prefix: str, width: int, order: list[str], first: int = 1) -> DataFrame:
    """rows with `seq` and `seq_id` over a total order. Ranges are sorted in parallel and numbered from their sizes."""
    from ..plans.staging import cut

    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_zero"))
    before = sizes.select("_part", "_zero", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))  # one row a partition
    seq = F.col("_before") + F.col("_at") - F.col("_zero") + first
    out = ranged.join(F.broadcast(before), "_part")
    return out.select(*rows.columns, seq.alias("seq"), F.concat(F.lit(prefix), F.lpad(seq.cast("string"), F.greatest(F.lit(width), F.length(seq.cast("string"))), F.lit("0"))).alias("seq_id"))


def adjacent_edges(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(src, dst) of consecutive rows of each group."""
    nxt = F.lead(key).over(W.partitionBy(group).orderBy(order))
    return rows.select(group, F.col(key).alias("src"), nxt.alias("dst")).where("dst is not null")


def round_robin(numbered: DataFrame, n: int) -> DataFrame:
    """numbered (seq from 1) with `slot`, dealt in turn."""
    return numbered.withColumn("slot", F.pmod(F.col("seq") - 1, F.lit(n)))


def fallback_names(hits: DataFrame, first: int = 30, most: int = 24) -> DataFrame:
    """The first lines that hit, then distinct, then cut: per document. hits: doc_id, i, line."""
    a = hits.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("i"))).where(F.col("r") <= first)
    b = a.groupBy("doc_id", "line").agg(F.min("i").alias("i"))
    return b.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy("i"))).where(F.col("seq") <= most).select("doc_id", "seq", F.col("line").alias("name"))


def pass_rate(flags: DataFrame, flag: str = "passed") -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.col(flag))
    return flags.agg(n.alias("total"), ok.alias("passed"), (n - ok).alias("rejected"), F.coalesce(F.round(F.try_divide(ok, n), 4), F.lit(0.0)).alias("pass_rate"))


def chapter_rollup(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections, characters and code blocks of every chapter, zeros for one without text."""
    s = sections.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("sections"), F.sum("char_count").alias("chars"), F.sum("code_block_count").alias("code_blocks"))
    return chapters.select("chapter_id").join(s, "chapter_id", "left").na.fill(0)
