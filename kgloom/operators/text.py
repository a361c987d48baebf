"""Cleaning and segmentation of texts as ordered lines.

Lines are rows (doc_id, i, line); what depends on neighbours is a window in a document. Where whole runs of lines matter
(table of contents, broken lines, code blocks), expressions give every line a kind of one letter, and a pandas UDF finds
the runs as matches of a pattern in the document's string of kinds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.scalars import any_match, has_any, py_strip

def by_doc():
    return W.partitionBy("doc_id").orderBy("i")

FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF = "".join(map(chr, range(0x21, 0x7F)))


def normalize_encoding(c: Column) -> Column:
    """Line ends, control characters, full width, quotes, dashes, ellipses, bullets, runs of blanks."""
    # conditions look at c, so that nothing is worked out twice; what stands between them is beyond ASCII only, and a blank alone stays
    plain = F.regexp_replace(F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]+", "")
    out = F.when(F.regexp_like(c, F.lit("[！-～　“”‘’]")), F.translate(plain, FULL + "　“”‘’", HALF + " \"\"''")).otherwise(plain)
    out = F.regexp_replace(F.regexp_replace(out, "[‒–—―﹘]", "-"), "[…⋯]{1,2}", "...")
    out = F.regexp_replace(out, r"(?mU)^[。©◎○●□▪▸]\s+", "· ")
    return F.regexp_replace(F.when(F.octet_length(c) == F.length(c), plain).otherwise(out), "[ \t]{2,}|\t", " ")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(F.split(text, "\n")).alias("i", "line"))


def gather(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of line rows."""
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


def repeated_short(rows: DataFrame, low: int, high: int, times: int) -> DataFrame:
    """rows with `strip` and `repeated`: a line of low to high characters that its document has `times` times or more."""
    s = rows.withColumn("strip", py_strip(F.col("line")))
    return s.withColumn("repeated", F.length("strip").between(low, high) & (F.count(F.lit(1)).over(W.partitionBy("doc_id", "strip")) >= times))


def header_footer(rows: DataFrame, times: int = 3) -> DataFrame:
    """rows without page headers and footers: fixed forms, and short lines that repeat. Code has no protection here."""
    s = repeated_short(rows, 1, 30, times)
    return s.where(~(any_match(F.col("strip"), t.HEADER_FOOTER) & (F.col("strip") != "")) & ~F.col("repeated")).select("doc_id", "i", "line")


def in_code(marker: Column) -> Column:
    """Whether the last code marker up to this line opens a block: a latch, however unbalanced the markers."""
    return F.coalesce(F.last(F.when(marker.isin(t.CODE_START, t.CODE_END), marker), True).over(by_doc().rowsBetween(W.unboundedPreceding, 0)) == t.CODE_START, F.lit(False))


def adjacent_dedup(rows: DataFrame) -> DataFrame:
    """rows without a line outside code that equals the one before it; blank lines stay."""
    s = rows.withColumn("strip", py_strip(F.col("line")))
    s = s.withColumn("code", in_code(F.col("strip"))).withColumn("before", F.lag("strip").over(by_doc()))
    return s.where(F.col("code") | (F.col("strip") == "") | ~F.coalesce(F.col("strip") == F.col("before"), F.lit(False))).select("doc_id", "i", "line")


def noise_filter(rows: DataFrame, times: int = 4) -> DataFrame:
    """rows without noise and bare numbers outside code, and with runs of blank lines cut to one. A line of noise between
    blanks still ends their run."""
    s = repeated_short(rows, 2, 15, times).withColumn("marker", F.col("strip").isin(t.CODE_START, t.CODE_END))
    s = s.withColumn("code", in_code(F.col("strip")) | F.col("marker"))
    # the run of blanks: the last line that counts before this one (code within a block doesn't)
    counts = F.when(~F.col("code") | (F.col("strip") == t.CODE_START), F.col("strip") == "")
    s = s.withColumn("after_blank", F.coalesce(F.last(counts, True).over(by_doc().rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    noise = any_match(F.col("strip"), t.NOISE) | F.regexp_like("strip", F.lit(r"^\d{1,4}$")) | (F.col("repeated") & ~F.col("marker"))
    keep = F.when(F.col("code"), F.lit(True)).when(F.col("strip") == "", ~F.col("after_blank")).otherwise(~noise)
    return s.where(keep).select("doc_id", "i", F.when(~F.col("code") & (F.col("strip") == ""), F.lit("")).otherwise(F.col("line")).alias("line"))


def title_level(c: Column) -> Column:
    """1, 2 or 3 for a title line, else null; the first form that matches decides."""
    out = F.lit(None).cast("int")
    for level, pattern in reversed(t.TITLES):
        out = F.when(any_match(c, [pattern]), F.lit(level)).otherwise(out)
    return F.when(c.isin("", t.CODE_START, t.CODE_END), F.lit(None).cast("int")).otherwise(out)


def segments(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, section_id, title, text, char_count, has_code, level): text between title lines. Text of 1 to 29
    characters joins the segment before it; text before the first title is a preface, without titles there is one whole."""
    s = rows.withColumn("strip", py_strip(F.col("line"))).withColumn("level", title_level(F.col("strip")))
    s = s.withColumn("seg", F.count("level").over(by_doc()))
    title = F.max(F.when(F.col("level").isNotNull(), F.struct(F.substring("strip", 1, 60).alias("title"), "level")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("i", "line")))), lambda x: x["line"]), "\n")
    g = s.groupBy("doc_id", "seg").agg(title.alias("mark"), py_strip(body).alias("text"))
    w = W.partitionBy("doc_id").orderBy("seg")
    g = g.withColumn("marks", F.max("seg").over(W.partitionBy("doc_id"))).withColumn("ch", F.count_if(F.col("mark.level") == 1).over(w))
    g = g.where((F.col("seg") > 0) | (F.col("marks") == 0) | (F.col("text") != ""))
    short = (F.col("seg") > 0) & (F.length("text") > 0) & (F.length("text") < 30) & (F.row_number().over(w) > 1)
    g = g.withColumn("short", short).withColumn("own", F.sum(F.when(F.col("short"), 0).otherwise(1)).over(w))
    part = F.struct("seg", F.when(F.col("short"), F.concat_ws("\n", "mark.title", "text")).otherwise(F.col("text")).alias("t"))
    m = g.groupBy("doc_id", "own").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n").alias("text"),
                                       F.min_by(F.struct("seg", "marks", "mark", "ch", F.contains("text", F.lit(t.CODE_START)).alias("has_code")), "seg").alias("h"))
    number = lambda c: F.lpad(c.cast("string"), 2, "0")
    sid = (F.when(F.col("h.marks") == 0, "S01").when(F.col("h.seg") == 0, "S00").when(F.col("h.mark.level") == 1, F.concat(F.lit("CH"), number(F.col("h.ch"))))
           .otherwise(F.concat(F.lit("CH"), number(F.col("h.ch")), F.lit("_"), number(F.col("h.seg") - 1))))
    return m.select("doc_id", F.col("own").cast("int").alias("seq"), sid.alias("section_id"),
                    F.when(F.col("h.marks") == 0, "全文").when(F.col("h.seg") == 0, "前言").otherwise(F.col("h.mark.title")).alias("title"),
                    "text", F.length("text").alias("char_count"), F.col("h.has_code").alias("has_code"), F.col("h.mark.level").alias("level"))


def keywords(c: Column, words: list[str] | None = None, most: int = 30) -> Column:
    """The words that occur in the text, in the list's order."""
    low = F.lower(c)
    return F.slice(F.filter(F.array(*[F.lit(k) for k in words or t.KEYWORDS]), lambda k: F.contains(low, F.lower(k))), 1, most)


def corpus_sections(rows: DataFrame, chapter: int) -> DataFrame:
    """(doc_id, section, title, text, code_blocks, char_count): lines split at the numbered titles of a chapter, and
    prose parted from marked code; a block that isn't closed is lost."""
    sec = F.regexp_extract("line", t.SECTION_LINE, 1)
    title = py_strip(F.regexp_extract("line", t.SECTION_LINE, 2))
    hint = F.lit(False)
    for word in t.NOT_A_TITLE:
        hint = hint | F.contains(title, F.lit(word))
    head = (sec != "") & ~hint & (F.split(sec, r"\.")[0] == str(chapter))
    s = rows.withColumn("head", head).withColumn("seg", F.count_if("head").over(by_doc()))
    b = W.partitionBy("doc_id", "seg").orderBy("i")
    mark = F.when(F.col("line").isin(t.CODE_START, t.CODE_END), F.col("line"))
    s = s.withColumn("mark", mark).withColumn("code", F.coalesce(F.last("mark", True).over(b.rowsBetween(W.unboundedPreceding, 0)) == t.CODE_START, F.lit(False)))
    s = s.withColumn("block", F.count_if(F.col("mark") == t.CODE_START).over(b)).withColumn(
        "closed", F.first("mark", True).over(b.rowsBetween(1, W.unboundedFollowing)) == t.CODE_END)
    body = ~F.col("head") & F.col("mark").isNull()
    join = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("i", "line")))), lambda x: x["line"]), "\n")
    prose = s.groupBy("doc_id", "seg").agg(F.max(F.when(F.col("head"), F.struct(sec.alias("section"), title.alias("title")))).alias("h"), join(body & ~F.col("code")).alias("plain"), F.count(F.lit(1)).alias("n"))
    blocks = s.where(body & F.col("code") & F.col("closed")).groupBy("doc_id", "seg", "block").agg(py_strip(join(F.lit(True))).alias("code")).where("code <> ''")
    blocks = blocks.groupBy("doc_id", "seg").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "code"))), lambda x: x["code"]).alias("code_blocks"))
    return prose.join(blocks, ["doc_id", "seg"], "left").select(
        "doc_id", "seg", F.coalesce("h.section", F.lit(f"{chapter}.0")).alias("section"), F.coalesce(F.nullif("h.title", F.lit("")), F.lit("章节引言")).alias("title"), py_strip(F.col("plain")).alias("text"),
        F.coalesce("code_blocks", F.array().cast("array<string>")).alias("code_blocks"), F.length("plain").alias("char_count"))


def apply_rules(c: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A rule table of (kind, pattern, replacement) in order; kind is regex or literal."""
    for kind, pattern, new in rules:
        c = F.regexp_replace(c, pattern, new) if kind == "regex" else F.replace(c, F.lit(pattern), F.lit(new))
    return c


def _regex(rules: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    return [("regex", "(?U)" + pattern, new) for pattern, new in rules]


def _found(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(c, F.lit("(?U)" + p))
    return out


def looks_like_code(line: Column, bare: Column | None = None) -> Column:
    """Whether a line is indented or has a sign of code. The patterns are searched only in lines that have what they need."""
    bare = py_strip(line) if bare is None else bare
    needs = [F.regexp_like(bare, F.lit(t.CODE_MARKS)) | has_any(F.lower(bare), t.CODE_WORDS), *[F.lit(True) if n is None else F.contains(bare, F.lit(n)) for n in t.CODE_NEEDS]]
    signs = F.lit(False)
    for need, pattern in zip(needs, t.CODE_SIGNS, strict=True):
        signs = signs | (need & _found(bare, [pattern]))
    return (bare != "") & (F.startswith(line, F.lit("    ")) | F.startswith(line, F.lit("\t")) | signs)


# Kinds of lines, one letter each. bare: the line without white space at its ends, where it is at hand

def toc_kind(line: Column, bare: Column | None = None) -> Column:
    """T in a table of contents, B blank, O other."""
    bare = py_strip(line) if bare is None else bare
    # both patterns have that end, which is far cheaper to look for than what stands before it
    return F.when(bare == "", "B").when(_found(bare, [t.TOC_END]) & _found(bare, t.TOC_LINES), "T").otherwise("O")


def joint_kind(line: Column, bare: Column | None = None) -> Column:
    """S stands for itself, J may be the rest of the line before."""
    bare = py_strip(line) if bare is None else bare
    alone = (bare == "") | bare.isin(t.CODE_START, t.CODE_END) | _found(bare, [t.CHAPTER_TITLE, t.CODE_BEGIN, t.NUMBERED])
    return F.when(alone, "S").otherwise("J")


def code_kind(line: Column, bare: Column | None = None) -> Column:
    """B blank, M a marker, C code, N code that is a numbered title too; of other lines, what code may have in it and what a block
    may end with: D does both, F the first, T the second, P neither."""
    bare = py_strip(line) if bare is None else bare
    title = _found(bare, [t.CHAPTER_TITLE])
    filler = (F.length(bare) <= 5) | _found(bare, [t.CODE_FILLER])
    tail = ~title & _found(bare, t.TAIL_SIGNS)
    code = F.when(title, "N").otherwise("C")
    other = F.when(filler & tail, "D").when(filler, "F").when(tail, "T").otherwise("P")
    return F.when(bare.isin(t.CODE_START, t.CODE_END), "M").when(bare == "", "B").when(looks_like_code(line, bare), code).otherwise(other)


#: Fewest lines of a table of contents among how many.
TOC_LEAST, TOC_NEXT = 6, 10
#: Blank lines that code may have before it goes on, and lines that a block takes in behind it.
CODE_BLANKS, CODE_TAIL = 2, 8
CODE_RUN = re.compile("[CN](?:[DF]*(?:B[DF]*){0,%d}[CN])*[DF]*(?:B[DF]*){0,%d}" % (CODE_BLANKS, CODE_BLANKS))
TAIL_RUN = re.compile("[CDT]+(?:B[CDT]*)?")


def drop_toc(ls: list[str], kinds: str) -> list[tuple[int, str]]:
    """Runs of contents and blank lines leave only their titles, from where six of the next ten lines are contents. Numbers of
    the lines that stay, with their text."""
    out, at = [], 0
    for run in re.finditer("[TB]+", kinds):
        lo = next((i for i in range(*run.span()) if kinds.count("T", i, i + TOC_NEXT) >= TOC_LEAST), run.end())
        titles = [(i, re.match(t.TOC_TITLE, ls[i].strip())) for i in range(lo, run.end())]
        out += [(i, ls[i]) for i in range(at, lo)] + [(i, m[1].strip()) for i, m in titles if m and m[1].strip()]
        at = run.end()
    return out + list(enumerate(ls))[at:]


def _seam(line: str, rest: str) -> str | None:
    """What stands between a broken line and its rest in place of the break (a hyphen goes); None where the break is one."""
    bare = line.strip()
    if not bare or line[-1] in t.NO_MERGE_AFTER or len(bare) > 60:
        return None
    if line[-1] == "-" and rest[0].islower():
        return "-"
    han = len(re.findall("[一-鿿]", line)) > 0.3 * len(line)
    if han and len(bare) < 30 and line[-1] not in t.SENTENCE_END and not rest[0].isdigit():
        return ""
    return " " if len(bare) < 40 and line[-1].islower() and rest[0].islower() else None


def mend_breaks(ls: list[str], kinds: str) -> list[str]:
    """Lines that a page broke are joined, each joined line being the start of the next one's."""
    out: list[str] = []
    for line, kind in zip(ls, kinds, strict=True):
        seam = _seam(out[-1], line.strip()) if out and kind == "J" else None
        if seam is None:
            out.append(line)
        else:
            out[-1] = out[-1].removesuffix(seam if seam == "-" else "") + (" " if seam == " " else "") + line.strip()
        out[-1] = out[-1].rstrip()
    return out


def page_kind(line: Column, bare: Column | None = None) -> Column:
    return F.concat(toc_kind(line, bare), joint_kind(line, bare))


def mend_pages(ls: list[str], kinds: str) -> list[str]:
    """drop_toc and mend_breaks in one fold. A title starts as its line of contents does, so the line's kind serves for it."""
    kept = drop_toc(ls, kinds[::2])
    return mend_breaks([x for _, x in kept], "".join(kinds[2 * i + 1] for i, _ in kept))


def mark_code(ls: list[str], kinds: str) -> list[str]:
    """Runs of code of two lines or more go between markers, with the lines behind them that end them; blocks that touch
    are one, and markers alternate. Blank lines at the end of a run go."""
    parts: list[tuple[str, list[str]]] = []  # a block with kind X, or a line with its own
    at = 0
    for run in CODE_RUN.finditer(kinds):
        body = _trim(ls[slice(*run.span())])
        parts += [(k, [x]) for k, x in zip(kinds[at: run.start()], ls[at: run.start()], strict=True)]
        parts += [("X", body)] if len(body) > 1 else [(kinds[run.start()], body)]
        at = run.end()
    parts += [(k, [x]) for k, x in zip(kinds[at:], ls[at:], strict=True)]
    shape, out, at = "".join(k for k, _ in parts), [], 0
    for block in re.finditer("X", shape):
        out += [x for _, xs in parts[at: block.start()] for x in xs]
        tail = TAIL_RUN.match(shape, block.end(), block.end() + CODE_TAIL)
        at = tail.end() if tail else block.end()
        out += [t.CODE_START, *parts[block.start()][1], *_trim([x for _, xs in parts[block.end(): at] for x in xs]), t.CODE_END]
    return _alternating(out + [x for _, xs in parts[at:] for x in xs])


def _trim(ls: list[str]) -> list[str]:
    n = len(ls)
    while n and not ls[n - 1].strip():
        n -= 1
    return ls[:n]


def _alternating(ls: list[str]) -> list[str]:
    """Without ends that a start follows at once, and markers that repeat the one before; an open block ends with the text."""
    keep = [x for x, after in zip(ls, [*ls[1:], ""], strict=False) if (x, after) != (t.CODE_END, t.CODE_START)]
    out, last = [], t.CODE_END
    for x in keep:
        if x in (t.CODE_START, t.CODE_END):
            if x == last:
                continue
            last = x
        out.append(x)
    return [*out, t.CODE_END] if last == t.CODE_START else out


def dealt(docs: DataFrame) -> DataFrame:
    """docs dealt by document to as many partitions as the session has for shuffles. Without a number Spark would join partitions by their bytes, and a few
    tasks would get all texts: lines take far more time and memory than the bytes of a text say."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def fold(rows: DataFrame, kind: Callable[[Column, Column], Column], f: Callable[[list[str], str], list[str]]) -> DataFrame:
    """rows with each document's lines put through f, which gets the lines and the string of their kinds."""
    import pandas as pd

    def run(texts, kinds):
        return pd.Series([f(list(x), k) for x, k in zip(texts, kinds, strict=True)])

    run.__annotations__ = {"texts": pd.Series, "kinds": pd.Series, "return": pd.Series}
    # columns of their own, as an expression that several others take would be worked out for each
    kinds = rows.withColumn("bare", py_strip(F.col("line"))).withColumn("kind", kind(F.col("line"), F.col("bare")))
    both = kinds.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "line", "kind"))).alias("l"))
    new = F.pandas_udf(run, "array<string>")(F.col("l.line"), F.array_join("l.kind", ""))
    return dealt(both.select("doc_id", new.alias("l"))).select("doc_id", F.posexplode("l").alias("i", "line"))


# Repair by rule tables

@dataclass(frozen=True)
class Rules:
    """Rule tables of the text at hand, of which the general part is fixed: what a book's pages get wrong is its own.

    code, prose: (kind, pattern, replacement) for misread lines of each; snippets: the same for code after noise is gone;
    inserts: (line contains, line before isn't or is, which of these, new line) within code; rebuilds: (anchor, guards, lines);
    style, samples: (kind, pattern, replacement) for every line at the end; starts: (prefix, new line); drops: lines that go.
    """
    code: list = field(default_factory=list)
    prose: list = field(default_factory=list)
    snippets: list = field(default_factory=list)
    inserts: list = field(default_factory=list)
    rebuilds: list = field(default_factory=list)
    style: list = field(default_factory=list)
    starts: list = field(default_factory=list)
    drops: list = field(default_factory=list)
    samples: list = field(default_factory=list)


def garbled(line: Column) -> Column:
    """More than half capitals and blanks, hardly any character beyond ASCII, and no three small letters in a row."""
    n = F.greatest(F.length(line), F.lit(1))
    odd = F.length(F.regexp_replace(line, "[\\x00-\\x7F]+", ""))
    capitals = F.length(F.regexp_replace(line, "[^\\p{IsUppercase} ]+", ""))
    # small letters first: they are found soon where there are any, and spare the counts
    return ~F.regexp_like(line, F.lit("[a-z]{3,}")) & (F.length(py_strip(line)) > 5) & (odd < 0.1 * n) & (capitals > 0.5 * n)


def ocr_correction(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """rows with misread lines corrected: specks and garbled lines are blank, `/words/` is a comment again, then code and prose
    each go through their rules, the given ones first."""
    line = F.regexp_replace("line", r"/(?=[一-鿿][^/]{0,30}/)([一-鿿](?:[^/]*[^/\s])?)\s*/", "/* $1 */")
    marker = F.col("line").isin(t.CODE_START, t.CODE_END)
    s = rows.withColumn("code", in_code(F.col("line"))).withColumn("new", line).withColumn("bare", py_strip(F.col("new")))
    code = apply_rules(F.col("new"), rules.code + _regex(t.OCR_CODE_RULES))
    own = apply_rules(F.col("new"), rules.prose)
    prose = F.when(F.contains(own, F.lit("$")) | F.contains(own, F.lit("print")), apply_rules(own, _regex(t.OCR_TEXT_RULES))).otherwise(own)  # no rule fits without one of these
    new = (F.when(marker, F.col("line")).when(py_strip(F.col("line")).isin(*t.OCR_SPECKS) | garbled(F.col("new")) | F.startswith("bare", F.lit("《")), "")
           .when(F.col("code") | looks_like_code(F.col("new"), F.col("bare")), code).otherwise(prose))
    return s.select("doc_id", "i", new.alias("line"))


def insert_before(rows: DataFrame, contains: str, before: str, equal: bool, new: str) -> DataFrame:
    """rows with a line put in before each line of code that has a text, if the last line before it that isn't blank equals
    `before` (or doesn't)."""
    s = rows.withColumn("strip", py_strip(F.col("line")))
    s = s.withColumn("code", in_code(F.col("strip"))).withColumn("above", F.coalesce(F.last(F.nullif("strip", F.lit("")), True).over(by_doc().rowsBetween(W.unboundedPreceding, -1)), F.lit("")))
    same = F.col("above") == before
    hit = F.col("code") & F.contains("line", F.lit(contains)) & (same if equal else ~same)
    put = s.select("doc_id", F.col("i").alias("at"), F.posexplode(F.when(hit, F.array(F.lit(new), F.col("line"))).otherwise(F.array("line"))).alias("k", "line"))
    return put.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("at", "k")) - 1).alias("i"), "line")


def rebuild_block(anchor: str, guards: list[str], new: list[str]) -> Callable[[list[str], str], list[str]]:
    """A fold: behind the first line with the anchor, the first code block that has all guards gets new lines, once."""
    def f(ls: list[str], kinds: str) -> list[str]:
        at = next((i for i, x in enumerate(ls) if anchor in x), len(ls))
        for m in re.finditer("S[^SE]*E", kinds[at:]):
            lo, hi = at + m.start() + 1, at + m.end() - 1
            if all(any(g in x for x in ls[lo:hi]) for g in guards):
                return [*ls[:lo], *new, *ls[hi:]]
        return ls

    return f


def marker_kind(line: Column, bare: Column | None = None) -> Column:
    return F.when(line == t.CODE_START, "S").when(line == t.CODE_END, "E").otherwise("O")


def snippet_repair(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """rows with the rules' repairs of code, insertions and rebuilt blocks."""
    s = rows.withColumn("code", in_code(F.col("line")))
    rows = s.select("doc_id", "i", F.when(F.col("code") & (F.col("line") != t.CODE_START), apply_rules(F.col("line"), rules.snippets)).otherwise(F.col("line")).alias("line")) if rules.snippets else rows
    for rule in rules.inserts:
        rows = insert_before(rows, *rule)
    for rule in rules.rebuilds:
        rows = fold(rows, marker_kind, rebuild_block(*rule))
    return rows


def post_normalize(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """rows in one style: rules, lines that a start decides or that go, no adjacent duplicates, then the rules for samples."""
    s = rows.withColumn("line", apply_rules(F.col("line"), rules.style))
    bare, new = py_strip(F.col("line")), F.col("line")
    for prefix, whole in reversed(rules.starts):
        new = F.when(F.startswith(bare, F.lit(prefix)), F.lit(whole)).otherwise(new)
    started = F.lit(False)
    for prefix, _ in rules.starts:
        started = started | F.startswith(bare, F.lit(prefix))
    gone = ~started & bare.isin(*rules.drops) if rules.drops else F.lit(False)
    quiet = adjacent_dedup(s.where(~gone).select("doc_id", "i", new.alias("line")))
    return quiet.withColumn("line", apply_rules(F.col("line"), rules.samples))


def clean_document(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, text) of documents after encoding, headers, contents, line breaks, misread lines, code blocks, misread lines
    again, noise, snippets and style, in that order. A document whose lines all go is left out. Texts are dealt by document
    first, and again behind each fold: windows, counts and groups after that need no exchange of their own."""
    rows = header_footer(lines(dealt(docs.select("doc_id", normalize_encoding(F.col("text")).alias("text")))))
    rows = fold(rows, page_kind, mend_pages)
    rows = ocr_correction(fold(ocr_correction(rows, rules), code_kind, mark_code), rules)
    rows = post_normalize(snippet_repair(noise_filter(rows), rules), rules)
    return gather(rows)


def result_metrics(raw: DataFrame, cleaned: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, raw_chars, clean_chars, chapters_detected, has_code_blocks) of a cleaning run."""
    marks = parts.groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("chapters_detected"), F.bool_or("has_code").alias("has_code_blocks"))
    return (raw.select("doc_id", F.length("text").alias("raw_chars")).join(cleaned.select("doc_id", F.length("text").alias("clean_chars")), "doc_id").join(marks, "doc_id"))


def join_pages(pages: DataFrame) -> DataFrame:
    """(job_id, text) of pages that aren't blank, in page order."""
    full = pages.where(py_strip(F.col("text")) != "")
    return full.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))
