"""Triples from prose and code, and model answers into rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.scalars import alias_list, norm_rules, payload_rows, py_strip, repair_json, rule_alias_ok, sentences, span_ok
from .resolve import resolve, term_hits

RULE_COLUMNS = ["section_key", "subject_id", "subject_name", "predicate", "object_id", "object_name", "evidence", "source", "ord"]


def mentions(sections: DataFrame, terms: DataFrame) -> DataFrame:
    """MENTIONS_KP triples: for each section and node the longest of its terms that the title or text has.
    sections: section_key, title, text; terms: term, kp_id, name, ord."""
    texts = sections.select(F.col("section_key").alias("doc_id"), F.concat("title", F.lit("\n"), "text").alias("text"))
    hits = term_hits(texts, terms).join(terms, "term")
    best = hits.groupBy(F.col("doc_id").alias("section_key"), "kp_id").agg(
        F.max_by(F.struct("term", "name", "ord"), F.struct(F.length("term"), -F.col("ord"))).alias("b"))
    return best.select("section_key", F.col("section_key").alias("subject_id"), F.col("section_key").alias("subject_name"), F.lit("MENTIONS_KP").alias("predicate"),
                       F.col("kp_id").alias("object_id"), F.col("b.name").alias("object_name"), F.col("b.term").alias("evidence"), F.lit("text_rule").alias("source"), F.col("b.ord").alias("ord"))


def matches(sections: DataFrame, patterns: list[str], gate: Column | None = None) -> DataFrame:
    """(section_key, ord, evidence, left, right): every match of every two-group pattern in every sentence."""
    s = sections.select("section_key", F.posexplode(sentences(F.col("text"))).alias("s", "sentence"))
    s = s if gate is None else s.where(gate)
    found = F.flatten(F.array(*[F.transform(
        F.arrays_zip(*[F.regexp_extract_all("sentence", F.lit(p), g).alias(n) for g, n in ((0, "e"), (1, "l"), (2, "r"))]),
        lambda m, k=k: F.struct(F.lit(k).alias("p"), m["e"].alias("e"), m["l"].alias("l"), m["r"].alias("r"))) for k, p in enumerate(patterns)]))
    return s.select("section_key", "s", F.posexplode(found).alias("i", "m")).select(
        "section_key", (F.col("s").cast("long") * 1000 + F.col("i")).alias("ord"), F.col("m.e").alias("evidence"), py_strip(F.col("m.l")).alias("left"), py_strip(F.col("m.r")).alias("right"))


def _named(rows: DataFrame, side: str, dictionary: DataFrame) -> DataFrame:
    names = rows.select(F.col(side).alias("name")).distinct()
    r = resolve(names, dictionary, norm_rules, 3).select(F.col("name").alias(side), F.col("resolved").alias(f"{side}_kp"))
    return rows.join(r, side).where(F.col(f"{side}_kp").isNotNull())


def prerequisites(sections: DataFrame, dictionary: DataFrame) -> DataFrame:
    """PREREQUISITE triples. dictionary: key, value (struct kp_id, name), ordinal."""
    gate = F.lit(False)
    for w in t.PREREQUISITE_WORDS:
        gate = gate | F.contains("sentence", F.lit(w))
    m = matches(sections, t.PREREQUISITE_RULES, gate).where(span_ok(F.col("left")) & span_ok(F.col("right")))
    m = _named(_named(m, "left", dictionary), "right", dictionary).where("left_kp.kp_id <> right_kp.kp_id")
    return m.select("section_key", F.col("left_kp.kp_id").alias("subject_id"), F.col("left_kp.name").alias("subject_name"), F.lit("PREREQUISITE").alias("predicate"),
                    F.col("right_kp.kp_id").alias("object_id"), F.col("right_kp.name").alias("object_name"), "evidence", F.lit("text_rule").alias("source"), "ord")


def aliases(sections: DataFrame, dictionary: DataFrame) -> DataFrame:
    m = matches(sections, t.ALIAS_RULES).where(span_ok(F.col("left")) & rule_alias_ok(F.col("right"), F.col("evidence")))
    m = _named(m, "left", dictionary).where(norm_rules(F.col("right")) != norm_rules(F.col("left_kp.name")))
    return m.select("section_key", F.col("left_kp.kp_id").alias("subject_id"), F.col("left_kp.name").alias("subject_name"), F.lit("ALIAS").alias("predicate"),
                    F.lit(None).cast("string").alias("object_id"), F.col("right").alias("object_name"), "evidence", F.lit("text_rule").alias("source"), "ord")


def code_hints(sections: DataFrame) -> DataFrame:
    """MENTIONS_CODE_KP triples of sections' code blocks. sections: section_key, code_blocks."""
    hints = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(n).alias("n")) for h, n in t.CODE_HINTS.items()])
    b = sections.select("section_key", F.posexplode("code_blocks").alias("b", "code"))
    names = F.array_sort(F.array_distinct(F.transform(F.filter(hints, lambda x: F.contains("code", x["h"])), lambda x: x["n"])))
    r = b.select("section_key", "b", "code", F.posexplode(names).alias("i", "name"))
    return r.select("section_key", F.col("section_key").alias("subject_id"), F.col("section_key").alias("subject_name"), F.lit("MENTIONS_CODE_KP").alias("predicate"), F.lit(None).cast("string").alias("object_id"),
                    F.col("name").alias("object_name"), F.substring("code", 1, 160).alias("evidence"), F.lit("code_hint").alias("source"), (F.col("b").cast("long") * 1000 + F.col("i")).alias("ord"))


#: C source as tokens: what is passed over, then words and marks.
C_TOKEN = re.compile(r"""/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|^[ \t]*\#[^\n]*|(?P<word>[A-Za-z_]\w*)|(?P<mark>[(){}\[\];])|(?P<other>\S)""", re.S | re.M)
C_STATEMENTS = {"for": "For", "while": "While", "switch": "Switch"}
C_CALLS = {"printf": "Printf", "scanf": "Scanf", "malloc": "Malloc", "free": "Free"}
C_NOT_CALLS = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "goto"}
C_BEFORE_CALL = {"return", "else", "do", "case", "goto"}


def syntax_patterns(source: str) -> set[str] | None:
    """The patterns in C source by its tokens, without comments, strings and directives; None where brackets don't match.

    The end of a do is not a While. A name before a bracket is a call inside a body unless a type stands before it. A function that
    calls itself directly is a Recursion.
    """
    tokens = [m["word"] or m["mark"] or m["other"] for m in C_TOKEN.finditer(source) if m.lastgroup]
    close, stack = {}, []
    for i, x in enumerate(tokens):
        if x in ("(", "{", "["):
            stack.append(i)
        elif x in (")", "}", "]"):
            if not stack or tokens[stack[-1]] + x not in ("()", "{}", "[]"):
                return None
            close[stack.pop()] = i
    if stack:
        return None
    word = re.compile(r"[A-Za-z_]\w*").fullmatch
    at = lambda i: tokens[i] if 0 <= i < len(tokens) else ""
    bodies = [(at(i), close[i + 1] + 1, close[close[i + 1] + 1]) for i in range(len(tokens))
              if word(at(i)) and at(i + 1) == "(" and at(close[i + 1] + 1) == "{" and at(i) not in C_NOT_CALLS]
    within = lambda i: next((name for name, lo, hi in bodies if lo < i < hi), None)
    ends = set()  # the while of a do

    def statement(i: int) -> int:
        """The place behind the statement at i."""
        if at(i) == "{":
            return close[i] + 1
        if at(i) in ("for", "while", "switch", "if") and at(i + 1) == "(":
            i = statement(close[i + 1] + 1)
            return statement(i + 1) if at(i) == "else" else i
        if at(i) == "do":
            i = statement(i + 1)
            if at(i) == "while":
                ends.add(i)
        while i < len(tokens) and tokens[i] != ";":
            i = close.get(i, i) + 1
        return i + 1

    found = set()
    for i, x in enumerate(tokens):
        if x == "do":
            found.add("DoWhile")
            statement(i)
    for i, x in enumerate(tokens):
        if at(i + 1) != "(" or not word(x):
            continue
        if x in C_STATEMENTS:
            found |= set() if i in ends else {C_STATEMENTS[x]}
        elif (name := within(i)) and x not in C_NOT_CALLS and (not word(at(i - 1)) or at(i - 1) in C_BEFORE_CALL):
            found |= {C_CALLS[x.lower()]} if x.lower() in C_CALLS else {"BubbleSort"} if "sort" in x.lower() else set()
            found |= {"Recursion"} if x == name else set()
    return found


def calls_itself(source: str) -> bool:
    """Of text that is no syntax: whether a name with the head of an int function is followed by a call of it behind the head."""
    heads = re.finditer(r"int\s+(\w+)\s*\([^)]*\)\s*\{", source)
    return any(re.search(rf"\b{h[1]}\s*\(", source[source.index(h[1]) + len(h[1]):]) for h in heads)


def code_patterns(source: Column, parse: bool = True) -> Column:
    """The sorted names of the patterns in C source: by its tokens, or, if they don't fit or parse is false, by what the text has."""
    import pandas as pd

    low = F.lower(source)
    word = lambda p: F.regexp_like(source, F.lit(p))
    call = lambda p: F.contains(low, F.lit(p))
    fors = F.regexp_count(source, F.lit(r"for \(|for\("))
    bubble = call("bubble_sort") | ((fors >= 2) & call("temp") & call("arr[j]") & call("arr[j + 1]"))
    again = F.pandas_udf(lambda s: pd.Series([x is not None and calls_itself(x) for x in s]), "boolean")(source)
    tests = {"For": word(r"\bfor\s*\("), "While": word(r"\bwhile\s*\("), "DoWhile": word(r"\bdo\s*\{"), "Switch": word(r"\bswitch\s*\("), "Printf": call("printf("), "Scanf": call("scanf("),
             "Malloc": call("malloc("), "Free": call("free("), "Recursion": again, "BubbleSort": bubble}
    by_text = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())
    if not parse:
        return F.array_sort(by_text)

    def run(s):
        return pd.Series([None if x is None or (found := syntax_patterns(x)) is None else sorted(found) for x in s])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    by_syntax = F.pandas_udf(run, "array<string>")(source)
    return F.array_sort(F.coalesce(F.when(bubble, F.array_union(by_syntax, F.array(F.lit("BubbleSort")))).otherwise(by_syntax), by_text))


def code_triples(files: DataFrame, parse: bool = True) -> DataFrame:
    """IMPLEMENTS triples of source files (file_path, source)."""
    names = F.create_map(*[F.lit(x) for pair in t.CODE_PATTERNS.items() for x in pair])
    stem = F.regexp_extract("file_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return files.select("file_path", "source", F.explode(code_patterns(F.col("source"), parse)).alias("pattern")).select(
        stem.alias("subject_id"), stem.alias("subject_name"), F.lit("IMPLEMENTS").alias("predicate"), F.col("pattern").alias("object_name"), F.element_at(names, F.col("pattern")).alias("mapped_kp"),
        F.substring("source", 1, 180).alias("evidence"), F.lit("code_ast").alias("source"), "file_path")


def candidates(answers: DataFrame, vocabulary_check: Column | None = None, most: int = 2, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of model answers (_section_key, text): parsed, cleaned, and cut to the first `most` of a section. hints name the categories that a chapter's nodes
    may have, beside `other`; a chapter without hints takes all, and answers then have chapter_id too."""
    from ..functions.scalars import any_match, category, norm_name, truthy

    ddl = "name string, aliases string, category string, summary string, description string, code_example string, prerequisites array<string>, related array<string>"
    keys = ["_section_key", *(["chapter_id"] if hints else [])]
    r = answers.select(*keys, F.posexplode(payload_rows(F.col("text"), ddl)).alias("ord", "r")).select(*keys, "ord", "r.*")
    r = r.withColumn("name", norm_name(F.col("name"))).withColumn("category", category(F.col("category"))).withColumn("aliases", F.array_join(alias_list(F.col("aliases")), ","))
    ok = truthy(F.col("name")) & ~any_match(F.col("name"), t.GENERIC_NAMES) & (F.length(py_strip(F.col("description"))) >= 30) & ((F.col("category") != "other") | truthy(F.col("code_example")))
    if hints:
        of_chapter = F.element_at(F.create_map(*[x for k, v in hints.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]), F.col("chapter_id"))
        ok = ok & (F.coalesce(F.size(of_chapter), F.lit(0)) <= 0) | ok & (F.col("category") == "other") | ok & F.coalesce(F.array_contains(of_chapter, F.col("category")), F.lit(False))
    r = r.where(ok if vocabulary_check is None else ok & vocabulary_check)
    return r.withColumn("r", F.row_number().over(W.partitionBy("_section_key").orderBy("ord"))).where(F.col("r") <= most).drop("r")


def payload(c: Column, ddl: str) -> Column:
    """A model's object: as it is if that parses, else repaired. Null if neither does."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, ddl)), F.when(F.try_parse_json(repair_json(inner)).isNotNull(), F.from_json(repair_json(inner), ddl)))


def first_of(models: list[str], open_: Callable[[str], Callable[[str], str]], move_on: Callable[[Exception], bool]) -> Callable[[], Callable[[str], str]]:
    """A client for ask() that goes down a list of models: an error that move_on accepts (no such model, a timeout) takes the next one,
    other errors are raised, and the model that answered is asked first from then on."""
    def client() -> Callable[[str], str]:
        order = list(dict.fromkeys(models))

        def send(prompt: str) -> str:
            last: Exception = ValueError("no models")
            for model in list(order):
                try:
                    answer = open_(model)(prompt)
                except Exception as e:
                    if not move_on(e):
                        raise
                    last = e
                    continue
                order.remove(model)
                order.insert(0, model)
                return answer
            raise last

        return send

    return client


def ask(prompts: DataFrame, client: Callable[[], Callable[[str], str]], retries: int = 1, least: int = 80, usable: Callable[[str], bool] | None = None, pause_s: float = 0.0) -> DataFrame:
    """prompts (_section_key, prompt) with the text that a client answers, in Arrow batches; prompts shorter than `least` are passed
    over. client() opens one connection a task and returns a function. Errors, and answers that `usable` refuses, are tried again after
    a pause, then kept in `error`."""
    def run(batches: Iterator) -> Iterator:
        import time

        import pyarrow as pa

        send = client()
        for batch in batches:
            out: list[list] = [[], [], []]
            for key, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if prompt is None or len(prompt) < least:
                    continue
                text, error = None, None
                for turn in range(retries + 1):
                    if turn and pause_s:
                        time.sleep(pause_s)
                    try:
                        text, error = send(prompt), None
                    except Exception as e:  # a client's own errors, of any kind
                        error = str(e)
                        continue
                    if usable is None or usable(text):
                        break
                    text, error = None, "no usable answer"
                for column, x in zip(out, (key, text, error), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["_section_key", "text", "error"])

    return prompts.select("_section_key", "prompt").mapInArrow(run, "_section_key string, text string, error string")


def sse_data(stream: DataFrame) -> DataFrame:
    """Events of a line stream (i, line): the text behind `data:` up to the first `[DONE]`, whose place is one row for all tasks."""
    d = stream.where(F.startswith("line", F.lit("data:"))).select("i", F.trim(F.substring("line", F.lit(6), F.length("line"))).alias("data"))
    done = d.agg(F.min(F.when(F.col("data") == "[DONE]", F.col("i"))).alias("_done"))
    return d.join(F.broadcast(done), F.col("_done").isNull() | (F.col("i") < F.col("_done"))).select("i", "data")


def rule_triples(sections: DataFrame, terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions, prerequisites, aliases and code hints of every section, in that order, each fact of a section once."""
    from .dedup import RULE_KEY, last_wins

    out = None
    for n, part in enumerate((mentions(sections, terms), prerequisites(sections, dictionary), aliases(sections, dictionary), code_hints(sections))):
        part = part.select(*RULE_COLUMNS).withColumn("ord", F.struct(F.lit(n).alias("part"), F.col("ord").cast("bigint").alias("ord")))
        out = part if out is None else out.unionAll(part)
    return last_wins(out, RULE_KEY)
