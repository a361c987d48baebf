"""Cleaning, segmentation, matching and scoring over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import dedup, extract, quality, resolve, text
from .graphview import read

WORDS = ["for", "int", "the", "und", "ción", "eau", "do", "if"]
DOCS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"
LINES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (unnest(range(len(string_split(text, chr(10))))))::INTEGER AS i FROM ({DOCS})),
p AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS strip FROM l)"""
#: Characters that a term has at least.
LEAST = 2


def _lines(spark, d):
    return text.lines(read(spark, d, "documents"))


def _noted(spark, d):
    """Lines with a marker line where a document's number calls for one, so that code blocks occur."""
    l = _lines(spark, d)
    return l.withColumn("line", F.when((F.col("doc_id") % 3 == 0) & (F.col("i") == 2), text.t.CODE_START).when((F.col("doc_id") % 3 == 0) & (F.col("i") == 5), text.t.CODE_END)
                        .when(F.col("i") % 7 == 3, F.lit("")).when(F.col("i") % 7 == 4, F.lit(" ")).when(F.col("i") % 11 == 6, F.lit("***")).when(F.col("i") % 13 == 1, F.lit("42")).when(F.col("i") % 13 == 5, F.lit("第 7 页")).when(F.col("i") % 17 == 8, F.lit("图 3-1 流程")).when(F.col("i") % 19 == 2, F.lit("C语言程序设计")).when(F.col("i") % 19 == 10, F.lit("续表 内容")).otherwise(F.col("line")))


NOTED = LINES.replace("p AS (SELECT *, trim(line", """n AS (SELECT doc_id, i, CASE WHEN doc_id % 3 = 0 AND i = 2 THEN '[CODE_BLOCK_START]' WHEN doc_id % 3 = 0 AND i = 5 THEN '[CODE_BLOCK_END]'
 WHEN i % 7 = 3 THEN '' WHEN i % 7 = 4 THEN ' ' WHEN i % 11 = 6 THEN '***' WHEN i % 13 = 1 THEN '42' WHEN i % 13 = 5 THEN '第 7 页' WHEN i % 17 = 8 THEN '图 3-1 流程' WHEN i % 19 = 2 THEN 'C语言程序设计' WHEN i % 19 = 10 THEN '续表 内容' ELSE line END AS line FROM l),
p AS (SELECT *, trim(line""").replace("AS strip FROM l)", "AS strip FROM n)") + """,
m AS (SELECT *, coalesce(last_value(CASE WHEN strip IN ('[CODE_BLOCK_START]', '[CODE_BLOCK_END]') THEN strip END IGNORE NULLS) OVER w = '[CODE_BLOCK_START]', false) AS code,
 strip IN ('[CODE_BLOCK_START]', '[CODE_BLOCK_END]') AS marker, lag(strip) OVER (PARTITION BY doc_id ORDER BY i) AS before, count(*) OVER (PARTITION BY doc_id, strip) AS times
 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))"""


def _titled(spark, d):
    """Lines where every fifth is a numbered title."""
    return _lines(spark, d).withColumn("line", F.when(F.col("i") % 5 == 2, F.concat((F.col("i") % 3 + 1).cast("string"), F.lit("."), F.col("i").cast("string"), F.lit(" 节 标题"))).when(
        F.col("i") % 17 == 9, F.concat(F.lit("第"), F.col("i").cast("string"), F.lit("章 开头"))).otherwise(F.col("line")))


def _sections(spark, d):
    """Sections for extraction: conversations as text with phrases of the rules put in."""
    c = read(spark, d, "conversations")
    a, b = F.element_at(F.split("text", " "), 1), F.element_at(F.split("text", " "), -1)
    rule = F.when(F.col("turn") % 3 == 0, "先掌握循环语句再学习数组。指针(pointer)").when(F.col("turn") % 3 == 1, "理解指针是函数的基础。数组是学习指针的基础。数组,简称array_2").otherwise("循环是函数的前提。未知是数组的前提。函数(main)")
    phrase = F.concat(rule, a, F.lit("。函数又称"), b, F.lit("\n"))
    return c.select(F.concat_ws("_", "conv_id", "turn").alias("section_key"), F.col("role").alias("title"), F.concat(phrase, "text").alias("text"),
                    F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("for (i=0;i<n;i++) printf("), "text"))).otherwise(F.array(F.lit("int f(int n) { return f(n-1); }"), F.lit("while(1) free(p);"))).alias("code_blocks"))


def _kps(spark):
    rows = [("KP1", "循环语句", 0), ("KP2", "数组", 1), ("KP3", "指针", 2), ("KP4", "函数", 3), ("KP5", "循环", 4)]
    return spark.createDataFrame(rows, "kp_id string, name string, ord bigint")


def _dictionary(spark):
    k = _kps(spark)
    return k.select(s.norm_rules(F.col("name")).alias("key"), F.struct("kp_id", "name").alias("value"), F.col("ord").alias("ordinal"))


def _terms(spark, d):
    """Words of the benchmark texts, numbered by themselves."""
    b = read(spark, d, "benchmark")
    return b.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where(f"length(term) >= {LEAST}").distinct()


TERMS = f"terms AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS term FROM benchmark) WHERE length(term) >= {LEAST})"


def _candidates(spark, d):
    """Candidates from documents with labels: the first words are the name, the whole text is summary and description."""
    docs = read(spark, d, "documents").where("text is not null").join(read(spark, d, "labels"), "doc_id")
    name = F.when(F.col("doc_id") % 11 == 3, "循环结构").when(F.col("doc_id") % 13 == 4, F.concat(F.lit("数组的作用"), F.lit(" "))).otherwise(F.substring_index("text", " ", 2))
    return docs.select("doc_id", name.alias("name"), F.when(F.col("quality") == 1, "syntax").when(F.col("toxic") == 1, "odd").otherwise("other").alias("category"), F.col("text").alias("summary"),
                       F.col("text").alias("description"), F.when(F.col("doc_id") % 2 == 0, "x").otherwise("").alias("code_example"), F.when(F.col("doc_id") % 5 == 0, "MethodPattern").alias("candidate_type"),
                       F.when(F.col("doc_id") % 7 == 0, "KP1").alias("duplicate_of"))


def _seeds(spark, d):
    """A curated list: the words of the country names."""
    return read(spark, d, "nation").select(F.initcap(F.col("n_name")).alias("name"))


def _scored(spark, d):
    return quality.score(quality.with_similarity(_candidates(spark, d), _seeds(spark, d)))


_ANCHORS = "[" + ", ".join(f"'{a}'" for a in quality.t.ANCHORS) + "]"
_CHARS = "list_distinct(list_filter(string_split(lower({}), ''), lambda x: x <> ''))"
_GENERIC = "^(?:" + "|".join(quality.t.GENERIC_NAMES) + ")"
_REASONS = [("category = 'odd'", "'类别异常: odd'"), ("generic", "'命中过泛词'"), ("length(su) < 12", "'summary过短'"), ("length(de) < 40", "'description过短'"), ("code_example = ''", "'缺少代码示例'"),
            ("category = 'other'", "'category=other'"), ("candidate_type IS NOT NULL", "'candidate_type=MethodPattern'"), ("duplicate_of IS NOT NULL", "'duplicate_of=' || duplicate_of"),
            ("near >= 0.85", "'疑似与seed重复(' || printf('%.2f', near) || ')'")]
SCORED = f"""c AS (SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 3 THEN '循环结构' WHEN d.doc_id % 13 = 4 THEN '数组的作用 ' ELSE array_to_string(list_slice(string_split(d.text, ' '), 1, 2), ' ') END AS name, CASE WHEN quality = 1 THEN 'syntax' WHEN toxic = 1 THEN 'odd' ELSE 'other' END AS category,
 d.text AS summary, d.text AS description, CASE WHEN d.doc_id % 2 = 0 THEN 'x' ELSE '' END AS code_example, CASE WHEN d.doc_id % 5 = 0 THEN 'MethodPattern' END AS candidate_type,
 CASE WHEN d.doc_id % 7 = 0 THEN 'KP1' END AS duplicate_of FROM documents d JOIN labels USING (doc_id) WHERE d.text IS NOT NULL),
n AS (SELECT *, regexp_replace(name, '\\s+', '', 'g') AS nn, trim(summary, ' ' || chr(10) || chr(9) || chr(13)) AS su, trim(description, ' ' || chr(10) || chr(9) || chr(13)) AS de FROM c),
names AS (SELECT DISTINCT nn, {_CHARS.format('nn')} AS a FROM n),
seeds AS (SELECT DISTINCT {_CHARS.format("regexp_replace(n_name, ' ', '', 'g')")} AS b FROM nation),
near AS (SELECT nn, max(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END) AS near FROM names, seeds GROUP BY nn),
f AS (SELECT n.*, near.near, regexp_matches(nn, '{_GENERIC}') AS generic, len(list_filter({_ANCHORS}, lambda k: contains(lower(nn), k) OR contains(de, k))) > 0 AS anchor FROM n JOIN near USING (nn)),
scored AS (SELECT *, CASE WHEN nn = '' THEN 0 ELSE greatest(0, least(100, 100 + CASE WHEN anchor THEN 8 ELSE 0 END - CASE WHEN category = 'odd' THEN 25 ELSE 0 END - CASE WHEN generic THEN 35 ELSE 0 END - CASE WHEN length(su) < 12 THEN 10 ELSE 0 END
 - CASE WHEN length(de) < 40 THEN 20 ELSE 0 END - CASE WHEN code_example = '' THEN 8 ELSE 0 END - CASE WHEN category = 'other' THEN 20 ELSE 0 END - CASE WHEN candidate_type IS NOT NULL THEN 25 ELSE 0 END
 - CASE WHEN duplicate_of IS NOT NULL THEN 20 ELSE 0 END - CASE WHEN near >= 0.85 THEN 25 ELSE 0 END)) END::INTEGER AS score,
 CASE WHEN nn = '' THEN 'empty_name' WHEN length(de) < 20 THEN 'description_too_short' WHEN generic THEN 'generic_name' WHEN duplicate_of IS NOT NULL THEN 'duplicate_of_seed' WHEN candidate_type IS NOT NULL THEN 'method_pattern' END AS reject FROM f)"""


def _greedy(spark, d):
    c = _candidates(spark, d)
    return dedup.greedy(c.select(F.col("doc_id").alias("ord"), F.col("category").alias("section_key"), "name"))


def _resolved(spark, d):
    t = _terms(spark, d)
    names = t.select(F.substring("term", 1, 5).alias("name")).distinct()
    dictionary = t.select(F.col("term").alias("key"), F.upper("term").alias("value"), F.crc32(F.col("term").cast("binary")).alias("x"), F.length("term").alias("n")).select("key", "value", F.struct("n", "key").alias("ordinal"))
    return resolve.resolve(names, dictionary, s.norm_rules, 3)


def _encoded(spark, d):
    docs = read(spark, d, "documents").where("text is not null").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = read(spark, d, "pages").select(F.lit("pages"), "page_id", F.col("html"))
    both = docs.unionAll(pages)
    odd = F.concat("text", F.lit("\r\nＡＢ（１）　“q” ‘x’ –—…⋯ \t y\n"))
    return both.select("kind", "id", text.normalize_encoding(odd).alias("text"))


def _cleaned(spark, d):
    return text.clean_document(read(spark, d, "documents").where("text is not null"))


def _matched(spark, d):
    return resolve.term_hits(read(spark, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("text")), _terms(spark, d))


def _longest(spark, d):
    hits = _matched(spark, d).select(F.col("doc_id").alias("section_key"), F.substring("term", 1, 1).alias("kp_id"), "term", F.crc32(F.col("term").cast("binary")).alias("ord"))
    return dedup.longest_term(hits).select("section_key", "kp_id", F.length("term").alias("n"))


QUERIES = {
    "normalize_encoding": _encoded,
    "header_footer": lambda spark, d: text.header_footer(_noted(spark, d)),
    "line_repeat_filter": lambda spark, d: text.repeated_short(_lines(spark, d), 1, 30, 2).where("repeated").select("doc_id", "i", "strip"),
    "blank_compress": lambda spark, d: text.noise_filter(_noted(spark, d)).where("trim(line) = ''").select("doc_id", "i"),
    "noise_filter": lambda spark, d: text.noise_filter(_noted(spark, d)),
    "adjacent_dedup": lambda spark, d: text.adjacent_dedup(_noted(spark, d).withColumn("line", F.when(F.col("i") % 4 == 1, F.lit("same")).when(F.col("i") % 4 == 2, F.lit("same ")).otherwise(F.col("line")))),
    "segments": lambda spark, d: text.segments(_titled(spark, d)),
    "keywords": lambda spark, d: read(spark, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("text"), WORDS, 5), ",").alias("found")),
    "sentence_split": lambda spark, d: read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(s.sentences(F.replace("text", F.lit(". "), F.lit("。")))).alias("i", "sentence")),
    "head_mid_tail": lambda spark, d: read(spark, d, "documents").select("doc_id", s.head_mid_tail(F.col("text")).alias("sampled")),
    "corpus_sections": lambda spark, d: text.corpus_sections(_titled(spark, d), 1).select("doc_id", "seg", "section", "title", "char_count"),
    "clean_document": _cleaned,
    "term_match": _matched,
    "longest_term": _longest,
    "resolve_partial": _resolved,
    "mentions": lambda spark, d: extract.mentions(_sections(spark, d), _kps(spark).withColumnRenamed("name", "term").join(_kps(spark).select("kp_id", "name"), "kp_id")).drop("ord"),
    "prerequisite_rules": lambda spark, d: extract.prerequisites(_sections(spark, d), _dictionary(spark)).drop("ord"),
    "alias_rules": lambda spark, d: extract.aliases(_sections(spark, d), _dictionary(spark)).drop("ord"),
    "code_hints": lambda spark, d: extract.code_hints(_sections(spark, d)),
    "code_patterns": lambda spark, d: extract.code_triples(_sections(spark, d).select(F.concat(F.lit("code/"), "section_key", F.lit(".c")).alias("file_path"), F.array_join("code_blocks", "\n").alias("source"))),
    "jaccard_pairs": lambda spark, d: dedup.near_pairs(_candidates(spark, d), _seeds(spark, d), 0.5).withColumn("similarity", F.round("similarity", 6)),
    "quality_score": lambda spark, d: _scored(spark, d).select("doc_id", "quality_score"),
    "hard_reject": lambda spark, d: _scored(spark, d).select("doc_id", "quality_hard_reject"),
    "quality_reasons": lambda spark, d: _scored(spark, d).select("doc_id", F.array_join("quality_reasons", "; ").alias("reasons")),
    "gate_report": lambda spark, d: dedup.pass_rate(_scored(spark, d).select(quality.passes().alias("passed"))),
    "greedy_dedup": _greedy,
}

_NOISE = f"""WITH {NOTED}, a AS (SELECT *, coalesce(last_value(CASE WHEN NOT (code OR marker) OR strip = '[CODE_BLOCK_START]' THEN strip = '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_blank FROM m)
SELECT doc_id, i, CASE WHEN NOT (code OR marker) AND strip = '' THEN '' ELSE line END AS line FROM a WHERE CASE WHEN code OR marker THEN true WHEN strip = '' THEN NOT after_blank
 ELSE NOT (regexp_matches(strip, '^(?:{"|".join(text.t.NOISE)})') OR regexp_matches(strip, '^\\d{{1,4}}$') OR (length(strip) BETWEEN 2 AND 15 AND times >= 4)) END"""
#: Sections as the queries make them, their sentences, and the names that rules resolve to.
_SECTIONS = """s AS (SELECT conv_id || '_' || turn AS section_key, role AS title, turn,
 CASE turn % 3 WHEN 0 THEN '先掌握循环语句再学习数组。指针(pointer)' WHEN 1 THEN '理解指针是函数的基础。数组是学习指针的基础。数组,简称array_2' ELSE '循环是函数的前提。未知是数组的前提。函数(main)' END
 || split_part(text, ' ', 1) || '。函数又称' || string_split(text, ' ')[-1] || chr(10) || text AS text,
 CASE WHEN turn % 2 = 0 THEN ['for (i=0;i<n;i++) printf(' || text] ELSE ['int f(int n) { return f(n-1); }', 'while(1) free(p);'] END AS code_blocks FROM conversations),
k AS (SELECT * FROM (VALUES ('KP1', '循环语句', 0), ('KP2', '数组', 1), ('KP3', '指针', 2), ('KP4', '函数', 3), ('KP5', '循环', 4)) t(kp_id, name, ord)),
sentences AS (SELECT section_key, unnest(list_filter(list_transform(regexp_split_to_array(text, '[。！？；\\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')) AS sentence FROM s)"""
_SPAN = "length(trim({0})) BETWEEN 2 AND 20 AND NOT regexp_matches({0}, '[(){{}}\\[\\];,:#%*/\\\\\"]') AND trim({0}) NOT IN (" + ", ".join(f"'{w}'" for w in extract.t.SPAN_NOISE) + ")"
_RESOLVE = """(SELECT coalesce(max(CASE WHEN kk.name = lower({0}) THEN kk.kp_id END), CASE WHEN length({0}) >= 3 THEN min_by(kk.kp_id, kk.ord) FILTER (contains(kk.name, lower({0})) OR contains(lower({0}), kk.name)) END) FROM k kk)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rule_sql(patterns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT section_key, {n} AS p, unnest(regexp_extract_all(sentence, '{p}', 0)) AS evidence, unnest(regexp_extract_all(sentence, '{p}', 1)) AS l, unnest(regexp_extract_all(sentence, '{p}', 2)) AS r, sentence FROM sentences"
                              for n, p in enumerate(patterns))


SQL = {
    "blank_compress": f"SELECT doc_id, i FROM ({_NOISE}) WHERE trim(line) = ''",
    "normalize_encoding": """WITH b AS (SELECT 'documents' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'pages', page_id, html FROM pages),
o AS (SELECT kind, id, text || chr(13) || chr(10) || 'ＡＢ（１）　“q” ‘x’ –—…⋯ ' || chr(9) || ' y' || chr(10) AS t FROM b),
a AS (SELECT kind, id, translate(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), """ + _quoted(text.FULL + "　“”‘’") + ", " + _quoted(text.HALF + " \"\"''") + """) AS t FROM o)
SELECT kind, id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[‒–—―﹘]', '-', 'g'), '[…⋯]{1,2}', '...', 'g'), '(?m)^[。©◎○●□▪▸]\\s+', '· ', 'g'), '[ \\t]+', ' ', 'g') AS text FROM a""",
    "mentions": f"""WITH {_SECTIONS} SELECT section_key, section_key AS subject_id, section_key AS subject_name, 'MENTIONS_KP' AS predicate, kp_id AS object_id, name AS object_name, name AS evidence, 'text_rule' AS source
FROM s JOIN k ON contains(s.title || chr(10) || s.text, k.name)""",
    "prerequisite_rules": f"""WITH {_SECTIONS}, f AS ({_rule_sql(extract.t.PREREQUISITE_RULES)}),
g AS (SELECT *, {_RESOLVE.format('l')} AS a, {_RESOLVE.format('r')} AS b FROM f WHERE (contains(sentence, '前提') OR contains(sentence, '基础') OR contains(sentence, '先掌握')) AND {_SPAN.format('l')} AND {_SPAN.format('r')})
SELECT section_key, a AS subject_id, ka.name AS subject_name, 'PREREQUISITE' AS predicate, b AS object_id, kb.name AS object_name, evidence, 'text_rule' AS source FROM g JOIN k ka ON ka.kp_id = a JOIN k kb ON kb.kp_id = b WHERE a <> b""",
    "alias_rules": f"""WITH {_SECTIONS}, f AS ({_rule_sql(extract.t.ALIAS_RULES)}), g AS (SELECT *, {_RESOLVE.format('l')} AS a FROM f WHERE {_SPAN.format('l')} AND length(r) BETWEEN 2 AND 20 AND lower(r) NOT IN ({", ".join(f"'{w}'" for w in extract.t.RULE_ALIAS_BLOCK)})
 AND NOT regexp_matches(r, '^[0-9\\W_]+$') AND NOT regexp_matches(r, '[{{}};,]') AND len(list_filter([{", ".join(f"'{w}'" for w in extract.t.RULE_EVIDENCE)}], lambda w: contains(evidence, w))) = 0 AND NOT (regexp_matches(r, '^[a-z_\\-]+$') AND length(r) <= 5))
SELECT section_key, a AS subject_id, ka.name AS subject_name, 'ALIAS' AS predicate, NULL::VARCHAR AS object_id, r AS object_name, evidence, 'text_rule' AS source FROM g JOIN k ka ON ka.kp_id = a WHERE lower(r) <> ka.name""",
    "code_hints": f"""WITH {_SECTIONS}, c AS (SELECT section_key, unnest(code_blocks) AS code, unnest(range(len(code_blocks))) AS b FROM s),
n AS (SELECT section_key, code, b, list_sort(list_distinct(list_transform(list_filter([{", ".join(f"{{'h': '{h}', 'n': '{n}'}}" for h, n in extract.t.CODE_HINTS.items())}], lambda x: contains(code, x.h)), lambda x: x.n))) AS names FROM c)
SELECT section_key, section_key AS subject_id, section_key AS subject_name, 'MENTIONS_CODE_KP' AS predicate, NULL::VARCHAR AS object_id, unnest(names) AS object_name, substr(code, 1, 160) AS evidence, 'code_hint' AS source, b * 1000 + unnest(range(len(names))) AS ord FROM n""",
    "header_footer": f"""WITH {NOTED} SELECT doc_id, i, line FROM m WHERE NOT (strip <> '' AND (regexp_matches(strip, '^(?:{"|".join(text.t.HEADER_FOOTER)})')))
 AND NOT (length(strip) BETWEEN 1 AND 30 AND times >= 3)""",
    "line_repeat_filter": f"WITH {LINES} SELECT doc_id, i, strip FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, strip) AS n FROM p) WHERE length(strip) BETWEEN 1 AND 30 AND n >= 2",
    "adjacent_dedup": "WITH " + NOTED.replace("n AS (SELECT doc_id, i, CASE", "n AS (SELECT doc_id, i, CASE WHEN i % 4 = 1 THEN 'same' WHEN i % 4 = 2 THEN 'same '") + " SELECT doc_id, i, line FROM m WHERE code OR strip = '' OR before IS NULL OR strip <> before",
    "noise_filter": _NOISE,
    "keywords": "SELECT doc_id, array_to_string(list_slice(list_filter([" + ", ".join(f"'{w}'" for w in WORDS) + "], lambda k: contains(lower(text), k)), 1, 5), ',') AS found FROM documents",
    "sentence_split": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '。'), '[。！？；\\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS a FROM ({DOCS}))
SELECT doc_id, (unnest(range(len(a))))::INTEGER AS i, unnest(a) AS sentence FROM s""",
    "head_mid_tail": """SELECT doc_id, CASE WHEN length(text) <= 20000 THEN text ELSE substr(substr(text, 1, 6666) || chr(10) || chr(10) || '---中段样本---' || chr(10) || chr(10) || substr(text, length(text) // 2 - 3333 + 1, 6666)
 || chr(10) || chr(10) || '---后段样本---' || chr(10) || chr(10) || right(text, 6666), 1, 20000) END AS sampled FROM documents""",
    "term_match": f"WITH {TERMS} SELECT doc_id, term FROM ({DOCS}) d JOIN terms ON contains(lower(d.text), term)",
    "longest_term": f"WITH {TERMS} SELECT doc_id AS section_key, substr(term, 1, 1) AS kp_id, max(length(term))::INTEGER AS n FROM ({DOCS}) d JOIN terms ON contains(lower(d.text), term) GROUP BY ALL",
    "resolve_partial": f"""WITH {TERMS}, names AS (SELECT DISTINCT substr(term, 1, 5) AS name FROM terms), dict AS (SELECT term AS key, replace(upper(term), 'ẞ', 'SS') AS value FROM terms)
SELECT name, coalesce((SELECT value FROM dict WHERE key = name), first(value ORDER BY length(key), key) FILTER (value IS NOT NULL)) AS resolved FROM names LEFT JOIN dict ON contains(key, name) OR contains(name, key) GROUP BY name""",
    "jaccard_pairs": f"""WITH {SCORED}, a AS (SELECT DISTINCT name, {_CHARS.format('name')} AS a FROM c), b AS (SELECT DISTINCT array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name, {_CHARS.format('n_name')} AS b FROM nation),
j AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.a, b.b))::DOUBLE / (len(a.a) + len(b.b) - len(list_intersect(a.a, b.b))) AS s FROM a, b) SELECT a, b, round(s, 6) AS similarity FROM j WHERE s >= 0.5""",
    "quality_score": f"WITH {SCORED} SELECT doc_id, score AS quality_score FROM scored",
    "hard_reject": f"WITH {SCORED} SELECT doc_id, reject AS quality_hard_reject FROM scored",
    "quality_reasons": f"WITH {SCORED} SELECT doc_id, CASE WHEN nn = '' THEN '名称为空' ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {r} END" for c, r in _REASONS) + "], lambda x: x IS NOT NULL), '; ') END AS reasons FROM scored",
    "gate_report": f"""WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (reject IS NULL AND score >= 65) AS passed, count(*) FILTER (NOT (reject IS NULL AND score >= 65)) AS rejected,
 round(count(*) FILTER (reject IS NULL AND score >= 65) / count(*), 4) AS pass_rate FROM scored""",
}
