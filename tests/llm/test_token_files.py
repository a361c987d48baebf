"""Token files: round trip against the tokenizers library, what lies in a folder, reads of single documents."""

import hashlib
import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import op11_token_files as op


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op.vocabulary())


def expected(reference, docs):
    rows = [(r["doc_id"], reference.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    return sorted(((i, np.array(ids, "<u4").tobytes()) for i, ids in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("which", ["odd", "some", "empty"])
def test_round_trip(spark, which, request, reference, tmp_path):
    docs = request.getfixturevalue(which)
    rows, width = op.encode(docs.withColumn("IDS", F.lit("clash")), op.vocabulary())
    op.write(rows, width, f"file://{tmp_path}/t")
    found = op.read(spark, f"file://{tmp_path}/t").collect()
    wanted = expected(reference, docs)
    assert width == 2 and sorted(((r["doc_id"], bytes(r["ids"])) for r in found), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == wanted
    place, last = 0, None
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == place and r["n_tokens"] * 4 == len(r["ids"])
        assert last is None or (r["doc_id"] is not None and last <= r["doc_id"])
        place, last = place + r["n_tokens"], r["doc_id"]
    manifest = json.loads(Path(tmp_path, "t/manifest.json").read_bytes())
    assert manifest["n_ids"] == place and manifest["dictionary"] == hashlib.sha256(Path(tmp_path, "t/dictionary").read_bytes()).hexdigest()
    for s in manifest["shards"]:
        data = Path(tmp_path, "t", s["file"]).read_bytes()
        assert data.startswith(op.MAGIC + b"\2" + bytes.fromhex(manifest["dictionary"])) and data.endswith(op.MAGIC)


def test_query(spark, reference, some, tmp_path):
    docs = some.dropDuplicates(["doc_id"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    place, wanted = 0, []
    for i, ids in expected(reference, docs):
        wanted.append((i, place, len(ids) // 4, zlib.crc32(ids)))
        place += len(ids) // 4
    assert sorted(map(tuple, op.op11_token_files(spark, str(tmp_path)).collect())) == wanted


def test_access(spark, some, tmp_path):
    """A dictionary helps short documents; single documents read only their frames; a broken dictionary is noticed."""
    rows, width = op.encode(some, op.vocabulary())
    op.write(rows, width, f"file://{tmp_path}/t")
    assert Path(tmp_path, "t/dictionary").stat().st_size > 0
    every = {r["doc_id"]: tuple(r) for r in op.read(spark, f"file://{tmp_path}/t").collect()}
    ids = sorted(every)[3:60:19]
    assert {tuple(r) for r in op.read(spark, f"file://{tmp_path}/t", [*ids, -5]).collect()} == {every[i] for i in ids}
    assert op.read(spark, f"file://{tmp_path}/t", []).collect() == []
    Path(tmp_path, "t/dictionary").write_bytes(b"other")
    with pytest.raises(Exception, match="isn't the one"):
        op.read(spark, f"file://{tmp_path}/t").collect()


def test_retried(tmp_path):
    """Only what the manifest names is read: files of failed attempts don't count, and an aborted write leaves no manifest."""
    w = op.Writer({"path": f"file://{tmp_path}", "width": "2", "dictionary": hashlib.sha256(b"").hexdigest()})
    shard = lambda part, name, n: op.Shard(part, name, n, 3 * n, 1, 2)
    w.commit([shard(2, "c", 1), None, shard(0, "a", 2), shard(1, "", 0)])
    manifest = json.loads((tmp_path / "manifest.json").read_bytes())
    assert [(s["file"], s["start"]) for s in manifest["shards"]] == [("a", 0), ("c", 6)]
    (tmp_path / "x").write_bytes(b"half")
    w.abort([shard(0, "x", 1), None])
    assert not (tmp_path / "x").exists()


def test_spellings_of_a_word_are_kept_once():
    import tokenizers

    from kgloom.llm import op8_bpe as b8
    from kgloom.llm.op11_token_files import LibraryEncoder

    with open(b8.vocabulary(), encoding="utf-8") as f:
        data = f.read()
    one, library = LibraryEncoder(data, b8.classes(), 2), tokenizers.Tokenizer.from_str(data)
    texts = ["Word word WORD", "wOrd", "ÀÉ àé ß µ ÿ\xa0Ÿ", "İ Σας ΣΑΣ ǅ", "A\x1cB\x85C", "<S> <s> </S>", "É É", "", "Word, <|X|>   第1章"] + [f"x{s}Y" for s in one.special]
    for text in texts * 2:
        assert np.frombuffer(one.packed(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text
    kept = LibraryEncoder(data, b8.classes(), 2)
    kept.packed("Word word WORD")
    assert list(kept.table) == ["word"]
