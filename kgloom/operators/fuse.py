"""Triples of text, code and gold labels fused into one relation, with its entities and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fuse_alias_ok, literal, node_id, norm_fuse, or_empty, percent_path, predicate_name, py_strip, slug, truthy
from ..plans.staging import cut
from .dedup import counts_by, dedup_fused, upsert_entities
from .resolve import resolve

CSV_COLUMNS = ["subject_id", "subject_type", "subject_name", "predicate", "object_id", "object_type", "object_name", "source", "confidence", "section_key", "file_path", "pattern_name", "question", "evidence"]
BASE_URI = "http://example.org/c-course-kg/"
#: How far each kind of evidence is trusted.
CONFIDENCE = {"MENTIONS_KP": 0.75, "PREREQUISITE": 0.82, "ALIAS": 0.88, "IMPLEMENTS_KP": 0.9, "GOLD": 1.0}


def _or(column: str, other):
    return F.coalesce(F.nullif(F.col(column), F.lit("")), other)


def _resolved(names: list[DataFrame], dictionary: DataFrame) -> DataFrame:
    """(name, resolved) of the names in all of these tables of one column, as a table: it is made once, however many rows and branches read it."""
    every = names[0].toDF("name")
    for other in names[1:]:
        every = every.unionAll(other.toDF("name"))
    return cut(resolve(cut(every.where("name is not null").distinct()), cut(dictionary), norm_fuse).select("name", "resolved"))


def _ids(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("name").alias(name), F.col("resolved").alias(f"{name}_kp")), name, "left")


def _code_name():
    return _or("mapped_kp", or_empty(F.col("object_name")))


def _hints(rows: DataFrame) -> DataFrame:
    h = rows.select("*", F.explode("relation_hints").alias("h"))
    return h.withColumn("kind", F.upper(py_strip(or_empty(F.col("h.type"))))).withColumn("target", py_strip(or_empty(F.col("h.target")))).where("kind <> '' and target <> ''")


def text_names(rows: DataFrame) -> list[DataFrame]:
    return [rows.select("subject_name"), rows.select("object_name")]


def code_names(rows: DataFrame) -> list[DataFrame]:
    return [rows.select(_code_name())]


def gold_names(rows: DataFrame) -> list[DataFrame]:
    r = rows.where(truthy(F.col("sample_id")))
    return [r.select(F.explode("knowledge_points")), _hints(r).where("kind <> 'BELONGS_TO_CHAPTER'").select("target")]


def _fused(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(*[columns[c].alias(c) if c in columns else F.lit(None).cast("double" if c == "confidence" else "string").alias(c) for c in CSV_COLUMNS], "ord")


def from_text(rows: DataFrame, dictionary: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fused triples, entities) of rule triples with ord. Every row's section is an entity, whether the row stays or not. ids: the names
    resolved over the dictionary, if they are."""
    ids = _resolved(text_names(rows), dictionary) if ids is None else ids
    r = rows.withColumn("sec", _or("section_key", _or("subject_id", F.lit("UNKNOWN")))).withColumn("sec_id", node_id("SEC", F.col("sec")))
    r = _ids(_ids(r, "subject_name", ids), "object_name", ids)
    subject, target = _or("subject_id", F.col("subject_name_kp")), _or("object_id", F.col("object_name_kp"))
    kp = F.lit("KnowledgePoint")
    common = {"predicate": F.col("predicate"), "source": F.coalesce("source", F.lit("text_rule")), "evidence": or_empty(F.col("evidence")), "section_key": F.col("sec")}
    m = _fused(r.where((F.col("predicate") == "MENTIONS_KP") & target.isNotNull()), subject_id=F.col("sec_id"), subject_type=F.lit("Section"), subject_name=F.col("sec"),
               object_id=target, object_type=kp, object_name=or_empty(F.col("object_name")), confidence=F.lit(CONFIDENCE["MENTIONS_KP"]), **common)
    p = _fused(r.where((F.col("predicate") == "PREREQUISITE") & (subject != target)), subject_id=subject, subject_type=kp, subject_name=or_empty(F.col("subject_name")),
               object_id=target, object_type=kp, object_name=or_empty(F.col("object_name")), confidence=F.lit(CONFIDENCE["PREREQUISITE"]), **common)
    a = r.where((F.col("predicate") == "ALIAS") & subject.isNotNull() & truthy(F.col("object_name")) & fuse_alias_ok(F.col("object_name"), F.col("evidence")))
    alias_id = node_id("ALIAS", F.concat(subject, F.lit("_"), F.col("object_name")))
    alias = _fused(a, subject_id=alias_id, subject_type=F.lit("Alias"), subject_name=F.col("object_name"), object_id=subject, object_type=kp, object_name=or_empty(F.col("subject_name")),
                   confidence=F.lit(CONFIDENCE["ALIAS"]), **common)
    entity = lambda df, i, k, n: df.select(i.alias("entity_id"), F.lit(k).alias("entity_type"), n.alias("entity_name"), "ord")
    return m.unionByName(p).unionByName(alias), entity(r, F.col("sec_id"), "Section", F.col("sec")).unionByName(entity(a, alias_id, "Alias", F.col("object_name")))


def from_code(rows: DataFrame, dictionary: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    ids = _resolved(code_names(rows), dictionary) if ids is None else ids
    name = _or("subject_name", _or("subject_id", F.lit("unknown_code")))
    r = rows.withColumn("code_name", name).withColumn("code_id", node_id("CODE", _or("subject_id", name))).withColumn("kp_name", _code_name())
    f = _ids(r, "kp_name", ids).where("kp_name_kp is not null")
    fused = _fused(f, subject_id=F.col("code_id"), subject_type=F.lit("CodeExample"), subject_name=F.col("code_name"), predicate=F.lit("IMPLEMENTS_KP"), object_id=F.col("kp_name_kp"),
                   object_type=F.lit("KnowledgePoint"), object_name=F.col("kp_name"), source=F.coalesce("source", F.lit("code_ast")), evidence=or_empty(F.col("evidence")), section_key=F.lit(""),
                   file_path=or_empty(F.col("file_path")), pattern_name=or_empty(F.col("object_name")), confidence=F.lit(CONFIDENCE["IMPLEMENTS_KP"]))
    return fused, r.select(F.col("code_id").alias("entity_id"), F.lit("CodeExample").alias("entity_type"), F.col("code_name").alias("entity_name"), "ord")


def from_gold(rows: DataFrame, dictionary: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    ids = _resolved(gold_names(rows), dictionary) if ids is None else ids
    r = rows.where(truthy(F.col("sample_id"))).withColumn("sec", F.concat(or_empty(F.col("chapter_id")), F.lit("_"), or_empty(F.col("section"))))
    common = {"subject_id": F.col("sample_id"), "subject_type": F.lit("GoldSample"), "subject_name": F.col("sample_id"), "source": F.lit("gold_manual"), "evidence": or_empty(F.col("text_fragment")),
              "section_key": F.col("sec"), "confidence": F.lit(CONFIDENCE["GOLD"])}
    kps = _ids(r.select("*", F.explode("knowledge_points").alias("kp_name")), "kp_name", ids).where("kp_name_kp is not null")
    labels = _fused(kps, predicate=F.lit("GOLD_LABEL"), object_id=F.col("kp_name_kp"), object_type=F.lit("KnowledgePoint"), object_name=F.col("kp_name"), question=or_empty(F.col("question")), **common)
    h = _hints(r)
    home = h.where("kind = 'BELONGS_TO_CHAPTER'")
    chapters = _fused(home, predicate=F.col("kind"), object_id=F.col("target"), object_type=F.lit("Chapter"), object_name=F.col("target"), **common)
    rest = _ids(h.where("kind <> 'BELONGS_TO_CHAPTER'"), "target", ids).where("target_kp is not null")
    hints = _fused(rest, predicate=F.col("kind"), object_id=F.col("target_kp"), object_type=F.lit("KnowledgePoint"), object_name=F.col("target"), **common)
    entities = r.select(F.col("sample_id").alias("entity_id"), F.lit("GoldSample").alias("entity_type"), F.col("sample_id").alias("entity_name"), "ord").unionByName(
        home.select(F.col("target").alias("entity_id"), F.lit("Chapter").alias("entity_type"), F.col("target").alias("entity_name"), "ord"))
    return labels.unionByName(chapters).unionByName(hints), entities


def fuse(text: DataFrame, code: DataFrame, gold: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, entities) of the three sources; later sources' rows win. Their names are resolved once, together."""
    ids = _resolved([*text_names(text), *code_names(code), *gold_names(gold)], dictionary)
    parts = [from_text(text, dictionary, ids), from_code(code, dictionary, ids), from_gold(gold, dictionary, ids)]
    every = None
    for rank, (fused, _) in enumerate(parts):
        fused = fused.withColumn("ord", F.col("ord") + F.lit(rank * (1 << 48)))
        every = fused if every is None else every.unionByName(fused)
    return dedup_fused(every).drop("ord"), upsert_entities([e for _, e in parts])


def report(fused: DataFrame) -> DataFrame:
    return counts_by(fused, "predicate", "source")


def uri(c):
    return F.concat(F.lit("ckg:"), percent_path(slug(c)))


def rdf_lines(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(part, key, line): Turtle lines of entities by id, then of triples; order by part and key."""
    e = entities.select(F.lit(1).alias("part"), F.col("entity_id").alias("key"), F.concat(uri(F.col("entity_id")), F.lit(" a ckg:"), F.col("entity_type"), F.lit(" ; rdfs:label "), literal(F.col("entity_name")), F.lit(" .")).alias("line"))
    t = triples.select(F.lit(2).alias("part"), F.concat_ws("|", "subject_id", "predicate", "object_id").alias("key"),
                       F.concat(uri(F.col("subject_id")), F.lit(" ckg:"), predicate_name(F.col("predicate")), F.lit(" "), uri(F.col("object_id")), F.lit(" .")).alias("line"))
    return e.unionByName(t)


def csv_rows(fused: DataFrame) -> DataFrame:
    """The fixed columns of the CSV, absent and null as empty text."""
    return fused.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in fused.columns else F.lit("")).alias(c) for c in CSV_COLUMNS])


def linked(triples: DataFrame) -> DataFrame:
    """Triples that become edges: those with both ids."""
    from ..functions.scalars import truthy

    return triples.where(truthy(F.col("subject_id")) & truthy(F.col("object_id")))
