"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

The base counts of every text are computed once. The rules beyond the base filter are cheap predicates over the
counts or the text; a bounded sample gives each rule's cost (seconds a row) and selectivity (share rejected), and the
rules are nested in one CASE in the order of rejection per cost, so that a row pays only for the rules up to its first
failure. The order changes the cost, never the verdict.

Null or empty text: all counts 0, base_failed true, kept false. Repeated rows are judged alike, each for itself. An
empty table gives an empty result. Columns of the input other than id and text are passed on unless they clash with a
result's name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, others, quoted

#: Fixed parameters of the production cascade.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rows that the cost and selectivity estimate reads, about, and how often a timing takes each.
SAMPLE_ROWS, REPEATS = 2000, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Column], Column]  # from the text to "this text fails"


def _chars(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


#: Each rule rejects clear junk and leaves prose of any language alone.
RULES = [
    Rule("symbol_ratio", lambda t: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("word_length", lambda t: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("duplicate_lines", lambda t: F.col("n_dup_lines") * 10 > 3 * F.size(F.split(t, "\n"))),
    Rule("few_letters", lambda t: _chars(t, r"[^\p{L}]+") * 10 < 6 * F.col("word_chars")),
    Rule("many_digits", lambda t: _chars(t, r"[^0-9]+") * 10 > 3 * F.col("word_chars")),
    Rule("shouting", lambda t: _chars(t, r"[^\p{Lu}]+") * 2 > F.col("word_chars")),
    Rule("endless_word", lambda t: F.regexp_like(t, F.lit(r"[^\x20\x09-\x0D]{1000}"))),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, wherever the optimizer moves or copies the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS. Words inside repeated 3-word windows are found by sorting the windows' 96-bit hashes with
    their positions inside the row: linear memory and n log n time in a text's length, and no shuffle."""
    keep = others(docs, [*COUNTS, "_t", "_w", "_h", "_d"])
    t = F.coalesce(quoted(text), F.lit(""))
    base = docs.select(*[quoted(c) for c in keep], t.alias("_t"),
                       F.filter(F.split(t, SPACE), lambda w: w != "").alias("_w"))
    n = F.size("_w")
    window = lambda w, i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashed = base.withColumn("_h", let(F.col("_w"), lambda w: F.transform(starts, lambda i: F.xxhash64(*window(w, i)))))
    marked = F.sort_array(let(F.col("_w"), lambda w: F.transform(
        F.col("_h"), lambda h, i: F.struct(h.alias("h"), F.hash(*window(w, i)).alias("g"), i.alias("i")))))
    # A text with no equal windows, the common case, doesn't sort structs at all.
    none = F.size(F.array_distinct("_h")) == F.size("_h")
    ordered = hashed.withColumn("_d", F.when(~none, marked))
    same = lambda x, y: F.coalesce((y["h"] == x["h"]) & (y["g"] == x["g"]), F.lit(False))
    twice = let(F.col("_d"), lambda d: F.filter(d, lambda x, i: same(x, F.get(d, i - 1)) | same(x, F.get(d, i + 1))))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    lines = F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return ordered.select(
        *[quoted(c) for c in keep], F.col("_t"), n.cast("long").alias("n_words"),
        _chars(F.col("_t"), SPACE).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def plan(docs: DataFrame, text: str, rules: list[Rule], rows: int, n: int) -> list[tuple[Rule, float, float]]:
    """The rules in the order of rejection per cost, with the seconds a row and the share rejected of a sample of
    about `rows` of the n rows. Ties go by name."""
    if not n or not rules:
        return [(r, 0.0, 0.0) for r in rules]
    sample = with_counts(docs.sample(False, min(1.0, rows / n), 17).limit(4 * rows), text).where(~base_failed()).persist()
    try:
        shares = sample.agg(*[F.avg(r.fails(F.col("_t")).cast("double")).alias(r.name) for r in rules]).first()
        # a rule on one row takes microseconds, a job milliseconds: every row is taken several times, and a job that tests nothing off
        often = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def seconds(c: Column) -> float:
            took = []
            for _ in range(3):
                began = time.perf_counter()
                often.agg(F.count_if(c).alias("x")).first()
                took.append(time.perf_counter() - began)
            return min(took)

        idle = seconds(F.col("_time") < 0)
        least = 0.01 * idle
        measured = [(r, max(least, seconds(r.fails(F.col("_t"))) - idle) / (REPEATS * rows), float(shares[r.name] or 0.0)) for r in rules]
    finally:
        sample.unpersist()
    return sorted(measured, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(ordered: list[Rule]) -> Column:
    """True if no rule fails; a CASE stops at the first that does."""
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(rule.fails(F.col("_t")), F.lit(False)).otherwise(verdict)
    return F.when(base_failed(), F.lit(False)).otherwise(verdict)


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with COUNTS, base_failed and kept."""
    rules = RULES if rules is None else rules
    given = docs.select(*[quoted(c) for c in others(docs, ["base_failed", "kept"])])
    counted = with_counts(given, text)
    order = [r for r, _, _ in plan(given, text, rules, sample_rows, docs.count())]
    keep = [c for c in counted.columns if c != "_t"]
    return counted.select(*[quoted(c) for c in keep], base_failed().alias("base_failed"), cascade(order).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
