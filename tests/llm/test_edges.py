"""For every operator: columns that clash with its results, texts of some megabytes, empty side tables, missing settings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as brute5
from test_lines import brute as brute2
from test_repeats import brute4, brute9
from test_rows import brute1, brute3, reference8

import corpus_pipeline
from kgloom.llm import common, op1_quality, op2_lines, op3_decontam, op4_suffixes, op5_jaccard, op6_sharding, op7_language, op8_bpe, op9_debruijn, op10_tokens

CLASH = ["chunk", "N_WORDS", "n_removed", "kept", "Text_Crc32", "shard", "slot", "lang_pred", "token_ids", "n_tokens", "kept_text", "n_shingles", "hit_items", "_t", "_gone", "first"]


@pytest.fixture(scope="module")
def docs(spark):
    """Two texts of 1 MB that share passages, short ones, a null, repeated rows; every clashing name and one that doesn't clash."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(4000)}" for _ in range(120_000)]
    lines = [" ".join(words[i: i + 12]) for i in range(0, len(words), 12)]
    other = [f"v{rng.randrange(4000)} {x}" if i % 50 == 0 else x for i, x in enumerate(lines)]
    texts = ["\n".join(lines), "\n".join(other[:9000]), "short text", None, "\n".join(lines[:3])]
    rows = [(i, t, *["x"] * len(CLASH), f"row {i}") for i, t in enumerate(texts)] + [(4, texts[4], *["x"] * len(CLASH), "row 4")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASH) + ", other string").repartition(2).persist()


def kept(out):
    assert len({c.lower() for c in out.columns}) == len(out.columns) and "other" in out.columns
    rows = out.collect()
    assert sorted(r["other"] for r in rows) == ["row 0", "row 1", "row 2", "row 3", "row 4", "row 4"]
    return rows


def test_rows(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in kept(op1_quality.judge(docs)):
        assert tuple(r[c] for c in op1_quality.COUNTS) == brute1(texts[r["doc_id"]])
    items = [(1, " ".join(texts[0].split()[50_000:50_012])), (2, "short text")]
    for r in kept(op3_decontam.measure(op3_decontam.find(docs, spark.createDataFrame(items, "item_id bigint, text string")))):
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute3(texts[r["doc_id"]], items)
    for r in op6_sharding.shard(docs, nodes=2, shards=3).collect():  # carries no other columns
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
    model = op7_language.fit(docs.withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in kept(op7_language.predict(docs, model))} == {"en", "und"}
    ref = reference8()
    for r in kept(op8_bpe.encode(docs, op8_bpe.vocabulary(), decoded=False)):
        assert r["token_ids"] == ref.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
    counts = {r["doc_id"]: r["n_tokens"] for r in kept(op10_tokens.count_tokens(docs, op10_tokens.load(op10_tokens.vocabulary())))}
    assert counts[3] == 0 and counts[0] > counts[1] > counts[2] > 0


def test_corpus(docs):
    plain = docs.select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["lcp_lines"], r["kept_text"] or "") for r in kept(op2_lines.dedup(docs))) == sorted((*k[:4], k[4] or "") for k in brute2(plain, 1).elements())
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in kept(op4_suffixes.dedup(docs))) == sorted(brute4(plain, 200).elements())
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in kept(op5_jaccard.join(docs))) == sorted(brute5(plain).elements())
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept_text"].encode())) for r in kept(op9_debruijn.dedup(docs))) == sorted(brute9(plain, 20).elements())


def test_empty_benchmark(spark, odd):
    for rows in ([], [(1, None), (None, ""), (3, "... --")]):
        found = op3_decontam.measure(op3_decontam.find(odd, spark.createDataFrame(rows, "item_id bigint, text string"))).collect()
        assert len(found) == odd.count() and all(not r["contaminated"] and r["n_items"] == 0 for r in found)


def test_empty_pipeline(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_pipeline(spark, odd, tmp_path):
    """Null and equal ids, repeated rows, nulls in every column."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "no id here at all"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in out)


def test_equal_rows(spark, monkeypatch):
    """Rows equal in every column, and very many short rows, don't make one chunk."""
    from kgloom.llm import packed

    monkeypatch.setattr(packed, "CHUNK_ROWS", 10)
    rows = spark.createDataFrame([(1, "same")] * 80 + [(i, None) for i in range(80)], "doc_id bigint, text string").repartition(8)
    chunked, total = packed.in_chunks(rows)
    assert total == 320 and chunked.select("chunk").distinct().count() > 8


def test_shared_folder(spark):
    class Far:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Far())
    assert common.shared_dir(spark)


def test_staged_tables_go(spark):
    df = common.stage(spark.range(3))
    assert df.count() == 3
    common.remove(df)
    with pytest.raises(Exception, match="(?i)file|path"):
        df.count()
