"""Scalar building blocks as column expressions. Java's classes are ASCII by default, so patterns say (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables


#: Unicode white space, as `(?U)\\s` has it.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def py_strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def truthy(c: Column) -> Column:
    """A string that is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def _no_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def norm_fuse(c: Column) -> Column:
    """Lower case, ASCII parentheses, no white space."""
    return _no_space(F.translate(F.lower(or_empty(c)), "（）", "()"))


def norm_rules(c: Column) -> Column:
    """Lower case, no white space; parentheses stay."""
    return _no_space(F.lower(or_empty(c)))


def norm_name(c: Column) -> Column:
    """ASCII parentheses, no white space; case stays."""
    return _no_space(F.translate(or_empty(c), "（）", "()"))


def norm_seed(c: Column) -> Column:
    """Lower case, no U+0020; other white space stays."""
    return F.replace(F.lower(or_empty(c)), F.lit(" "), F.lit(""))


def slug(c: Column) -> Column:
    bare = F.regexp_replace(py_strip(or_empty(c)), r"(?U)[^\w一-鿿\-.]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def node_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), slug(c))


def literal(c: Column) -> Column:
    """A quoted Turtle literal."""
    out = or_empty(c)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def percent_path(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits, `_.-~` and slashes."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def jaccard_chars(a: Column, b: Column) -> Column:
    """Of the sets of characters of two texts in lower case; 0 if both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(or_empty(c)), ""), lambda v: v != "")) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def any_match(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches at the start."""
    return F.regexp_like(c, F.lit("(?U)^(?:" + "|".join(patterns) + ")"))


def has_any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def fuse_alias_ok(alias: Column, evidence: Column) -> Column:
    a = py_strip(or_empty(alias))
    return (F.length(a).between(2, 30) & ~F.lower(a).isin(*tables.FUSE_ALIAS_TOKENS) & ~F.regexp_like(a, F.lit(r"(?U)^[0-9\W_]+$"))
            & ~has_any(or_empty(evidence), tables.FUSE_EVIDENCE) & ~F.regexp_like(a, F.lit(r"[(){};,]")))


def rule_alias_ok(alias: Column, evidence: Column) -> Column:
    a = py_strip(or_empty(alias))
    return (F.length(a).between(2, 20) & ~norm_rules(a).isin(*tables.RULE_ALIAS_BLOCK) & ~F.regexp_like(a, F.lit(r"(?U)^[0-9\W_]+$"))
            & ~F.regexp_like(a, F.lit(r"[{};,]")) & ~has_any(evidence, tables.RULE_EVIDENCE) & ~(F.regexp_like(a, F.lit(r"^[a-z_\-]+$")) & (F.length(a) <= 5)))


def span_ok(c: Column) -> Column:
    s = py_strip(or_empty(c))
    return F.length(s).between(2, 20) & ~F.regexp_like(s, F.lit(r'[(){}\[\];,:#%*/\\"]')) & ~s.isin(*tables.SPAN_NOISE)


def predicate_name(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in tables.PREDICATES.items() for x in pair])
    return F.coalesce(F.element_at(known, c), F.lower(c))


def category(c: Column) -> Column:
    """Exact table first, then substrings in order, else `other`."""
    s = py_strip(or_empty(c))
    known = F.create_map(*[F.lit(x) for pair in tables.CATEGORIES.items() for x in pair])
    rules = F.lit("other")
    for words, name in reversed(tables.CATEGORY_RULES):
        rules = F.when(has_any(F.lower(s), words), F.lit(name)).otherwise(rules)
    return F.coalesce(F.element_at(known, s), rules)


def candidate_type(name: Column, kind: Column) -> Column:
    method = any_match(name, tables.METHOD_NAMES) | ((kind == "algorithm") & ~has_any(name, tables.CONCEPT_WORDS))
    return F.when(method, "MethodPattern").otherwise("KnowledgePoint")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(or_empty(c), r"[。！？；\n]+"), py_strip), lambda x: x != "")


def head_mid_tail(c: Column, limit: int = 20_000) -> Column:
    """The whole text, or its head, middle and tail with markers, cut at the limit."""
    n, part = F.length(c), max(2000, limit // 3)
    half = F.floor(n / 2).cast("int")
    start = F.greatest(F.lit(0), half - part // 2)
    middle = F.substring(c, start + 1, F.least(n, half + part // 2) - start)
    cut = F.concat(F.substring(c, 1, part), F.lit("\n\n---中段样本---\n\n"), middle, F.lit("\n\n---后段样本---\n\n"), F.right(c, F.lit(part)))
    return F.when(n <= limit, c).otherwise(F.substring(cut, 1, limit))


def clean_source(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"#include\s*<[^>]+>", ""), r"//.*", "")


def repair_json(c: Column) -> Column:
    """Model output as JSON: no fences, straight quotes, no comments, quoted keys and strings, no trailing commas."""
    out = F.translate(F.regexp_replace(py_strip(c), r"```json|```", ""), "“”‘’", "\"\"''")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)/\*.*?\*/", ""), r"//.*", "")
    out = F.regexp_replace(out, r"(?m)(^|[{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    out = F.regexp_replace(out, r"'([^'\\]*(?:\\.[^'\\]*)*)'", '"$1"')
    return F.regexp_replace(out, r",\s*([}\]])", "$1")


def payload_rows(c: Column, ddl: str) -> Column:
    """The rows of the outermost array of a model's answer, [] if there is none that parses."""
    bare = F.regexp_replace(or_empty(c), r"(?s)<think>.*?</think>|```(?:json)?", "")
    inner = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(F.nullif(inner, F.lit("")), f"array<struct<{ddl}>>"), F.array().cast(f"array<struct<{ddl}>>"))


def alias_list(c: Column) -> Column:
    """`[a, "b"]` or `a,b` as an array: trimmed, unquoted, first spelling of each normalized name."""
    parts = F.split(F.regexp_replace(py_strip(or_empty(c)), r"^\[|\]$", ""), ",")
    names = F.filter(F.transform(parts, lambda x: F.regexp_replace(py_strip(x), "^[\"']+|[\"']+$", "")), lambda x: x != "")
    keyed = F.transform(names, lambda x: F.struct(norm_fuse(x).alias("k"), x.alias("v")))
    return F.transform(F.aggregate(keyed, F.array().cast("array<struct<k:string,v:string>>"), lambda a, x: F.when(
        F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.concat(a, F.array(x)))), lambda x: x["v"])
