"""The pipeline against the brute-force versions of its stages, one after the other."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import test_jaccard
import test_lines
import test_rows

import corpus_pipeline
from kgloom.llm import op7_language, op8_bpe

LANGUAGES = {"en": "the and of to in was that", "de": "der und die von zu ist nicht", "fr": "le et la de que une pour"}


def made(n=60):
    rng = random.Random(5)
    rows, items = [], [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + rng.choice("abcdef") for _ in range(14))) for i in range(4)]
    for i in range(n):
        lang = list(LANGUAGES)[i % 3]
        ws = LANGUAGES[lang].split()
        lines = [" ".join(rng.choice(ws) + rng.choice(["", "er", "en"]) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 6))]
        if i % 7 == 3:
            lines.insert(0, items[i % 4][1])
        if i % 5 == 4:
            old = rows[i - 3]["text"].split("\n")
            lines = old[:1] + lines if i % 2 else [" ".join(["x", *old[0].split(" ")])] + old[1:]
        rows.append({"doc_id": i, "text": "\n".join(lines), "lang": lang, "source": "s", "n_chars": 0})
    rows += [{"doc_id": n, "text": None, "lang": "en", "source": "s", "n_chars": 0}, {"doc_id": n + 1, "text": "123 !!", "lang": None, "source": None, "n_chars": 0}]
    rows += [dict(rows[2], doc_id=n + 2), dict(rows[4], doc_id=n + 3)]
    return rows, items


def test_pipeline(spark, tmp_path):
    rows, items = made()
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    model = op7_language.fit(spark.read.parquet(f"{d}/documents.parquet"))
    judge = op7_language.make(model)()
    kept = [r for r, (lang, _, odd) in zip(rows, judge([r["text"] for r in rows]), strict=True) if lang != "und" and not odd]
    assert 10 < len(kept) < len(rows)
    lines = {k[0]: k for k in test_lines.brute(kept, 1)}
    kept = [dict(r, text=lines[r["doc_id"]][4]) for r in kept if not lines[r["doc_id"]][2] or lines[r["doc_id"]][2] < lines[r["doc_id"]][1]]
    first = {k[0]: k[2] for k in test_jaccard.brute(kept)}
    near = [r for r in kept if first[r["doc_id"]] == r["doc_id"]]
    assert len(near) < len(kept)
    clean = [r for r in near if not test_rows.brute3(r["text"], items)[4]]
    assert 0 < len(clean) < len(near)
    encoder = op8_bpe.Encoder(open(op8_bpe.vocabulary(), encoding="utf-8").read())
    got = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {r["doc_id"]: encoder.encode(r["text"]) for r in clean}
