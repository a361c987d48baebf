"""Text that goes to a model and comes from it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a section and of a code block in a prompt, blocks, and names of known nodes.
TEXT, CODE, BLOCKS, NAMES = 1500, 600, 2, 40
FENCE = r"(?s)```(\w*)\n?(.*?)```"


def chat(message: Column, related: Column, chapter: Column) -> Column:
    """The message, with related nodes and the chapter behind it where they are given."""
    return F.concat(message, F.when(F.coalesce(F.size(related), F.lit(0)) > 0, F.concat(F.lit("\n\n相关知识点: "), F.array_join(related, ", "))).otherwise(""),
                    F.when(F.coalesce(chapter, F.lit("")) != "", F.concat(F.lit("\n当前章节: "), chapter)).otherwise(""))


def extraction(template: str, title: Column, text: Column, blocks: Column, names: list[str]) -> Column:
    """A template whose {title}, {text}, {code} and {names} are a section's, each cut to its length."""
    code = F.array_join(F.transform(F.slice(F.coalesce(blocks, F.array().cast("array<string>")), 1, BLOCKS), lambda b: F.substring(b, 1, CODE)), "\n\n")
    out = F.lit(template)
    for key, value in (("names", F.lit("、".join(names[:NAMES]))), ("title", title), ("code", code), ("text", F.substring(text, 1, TEXT))):
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return out


#: What is asked about a node, about what comes after it, and about code. {name} and the like are filled in.
EXPLAIN = """请详细解释 C 语言中的"{name}"这个知识点。

信息：
- 章节: {chapter_id}
- 小节: {section}
- 别名: {aliases}
- 来源: {book} {pages}

请包括：
1. 基本概念
2. 实际应用
3. 常见错误
4. 代码示例

要求：
- 解释内容要通俗易懂
- 单独列出“来源”
- 不要虚构来源，只能基于已给出的信息整理"""
RECOMMEND = """我已经学过"{name}"，接下来应该学什么？

请推荐：
1. 3-5 个相关的后续知识点
2. 学习顺序
3. 为什么这样安排
4. 每个知识点的学习重点"""
REVIEW = """请审查以下 C 语言代码：

```c
{code}
```

请分析：
1. 代码的功能
2. 是否有问题或改进空间
3. 涉及的知识点"""


def _filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each {key} replaced at its place: what a value holds is never taken for a key."""
    parts, rest = [], template
    for key, value in values.items():
        before, _, rest = rest.partition("{" + key + "}")
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))


def explain(name: Column, node: dict[str, Column]) -> Column:
    """Asks for an explanation of a node. node: chapter_id, section, aliases, source_book, source, source_page, source_pages; null stands for a missing one
    and takes the default, empty text only where a source is named."""
    told = lambda c: F.nullif(c.cast("string"), F.lit(""))
    book = F.coalesce(told(node["source_book"]), told(node["source"]), F.lit("未记录"))
    page = node["source_page"].cast("string")
    pages = F.coalesce(told(node["source_pages"]), F.when(page.isNotNull() & ~page.isin("", "0"), F.concat(F.lit("第 "), page, F.lit(" 页"))), F.lit("未记录"))
    default = lambda key, word: F.coalesce(node[key].cast("string"), F.lit(word))
    return _filled(EXPLAIN, {"name": name, "chapter_id": default("chapter_id", "未知"), "section": default("section", "未知"), "aliases": default("aliases", "无"), "book": book, "pages": pages})


def recommend(name: Column) -> Column:
    """Asks what to learn after a node."""
    return _filled(RECOMMEND, {"name": name})


def code_review(code: Column) -> Column:
    """Asks for a review of C code."""
    return _filled(REVIEW, {"code": code})


def code_parts(text: Column) -> Column:
    """The fenced blocks of an answer as (lang, code)."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)).alias("lang"), F.regexp_extract_all(text, F.lit(FENCE), F.lit(2)).alias("code"))
    return F.transform(zipped, lambda x: F.struct(x["lang"].alias("lang"), F.rtrim(x["code"]).alias("code")))


def job_id(at: Column) -> Column:
    """A job's name: its time, and eight random hexadecimal digits."""
    return F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))
