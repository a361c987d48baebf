"""Operators that look at one row at a time, against brute force."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgloom.llm import op1_quality, op3_decontam, op7_language, op8_bpe, op10_tokens

WS = re.compile(r"[^\x20\x09-\x0D]+")


def brute1(text):
    t = text or ""
    w = WS.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    rep = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


@pytest.mark.parametrize("which", ["odd", "some", "empty"])
def test_quality(which, request):
    docs = request.getfixturevalue(which)
    for r in op1_quality.judge(docs.withColumn("kept", F.lit("clash"))).collect():
        want = brute1(r["text"])
        assert tuple(r[c] for c in op1_quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert isinstance(r["kept"], bool) and not (r["base_failed"] and r["kept"])


def kept1(text):
    """The verdict by plain counts: the base, then every rule."""
    t = text or ""
    n, chars, symbols, dup, rep = brute1(text)
    letters, upper = sum(unicodedata.category(c)[0] == "L" for c in t), sum(unicodedata.category(c) == "Lu" for c in t)
    digits = sum(c in "0123456789" for c in t)
    base = n < 50 or 100 * rep > 50 * n
    return not (base or symbols * 10 > n or chars < 2 * n or chars > 20 * n or dup * 10 > 3 * (t.count("\n") + 1) or letters * 10 < 6 * chars
                or digits * 10 > 3 * chars or upper * 2 > chars or re.search(r"[^\x20\x09-\x0D]{1000}", t))


def test_quality_verdict(spark, some):
    """Texts that fail one rule each, those of the sample, and none."""
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    texts = [good, good + " # * $ % & | < > # * $ % & | < > # * $ % &", " ".join("abcdefghij"[i % 10] for i in range(60)), good + "\n".join(["", *["same line"] * 90]), good.replace("word", "1 2 3 "),
             good.upper(), good + " " + "z" * 1000, good + " " + "1" * 999, " ".join("ö" * (i % 9 + 1) + chr(97 + i % 26) for i in range(70)), "½ " * 80]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").unionByName(some.select("doc_id", "text"))
    got = op1_quality.judge(docs).collect()
    assert [r["kept"] for r in got] == [kept1(docs_text) for docs_text in [r["text"] for r in docs.collect()]]
    assert {r["kept"] for r in got} == {True, False}


def test_quality_order(spark, some):
    counted = op1_quality.with_counts(some)
    order = op1_quality.plan(some, "text", op1_quality.RULES, 100, some.count())
    gain = [share / cost for _, cost, share in order]
    assert gain == sorted(gain, reverse=True) and {r.name for r, _, _ in order} == {r.name for r in op1_quality.RULES}
    every = op1_quality.cascade(op1_quality.RULES)
    other = op1_quality.cascade(op1_quality.RULES[::-1])
    assert all(r[0] == r[1] for r in counted.select(every, other).collect())


def low3(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute3(text, items):
    w, hit, found = low3(text), set(), set()
    places = {n: {} for n in range(1, 11)}
    for n, at in places.items():
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(w[k:k + n]), []).append(k)
    for i, t in items:
        iw = low3(t)
        n = min(10, len(iw))
        for j in range(len(iw) - n + 1 if n else 0):
            for k in places[n].get(tuple(iw[j:j + n]), ()):
                hit |= set(range(k, k + n))
                found.add(i)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("which", ["odd", "empty"])
@pytest.mark.parametrize("limit", [100_000, 12])
def test_decontamination(spark, which, limit, request):
    items = [(1, "one two three four five six seven eight nine ten"), (10, "ONE two three, four five six seven eight nine ten eleven"), (2, "a"), (3, None), (4, ""), (5, "the the the"), (6, "no id"), (6, "no id")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = request.getfixturevalue(which)
    for r in op3_decontam.measure(op3_decontam.find(docs, bench, max_windows=limit)).collect():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute3(r["text"], items), r["text"]


def test_decontamination_sample(spark, some):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    rows = op3_decontam.measure(op3_decontam.find(some, bench)).collect()
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute3(r["text"], items)
    assert any(r["contaminated"] for r in rows)


def test_language(spark, some, empty, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op7_language.fit(docs, max_rows=400)
    assert model.languages == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    got = op7_language.predict(docs, model).where(op7_language.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in op7_language.predict(odd, model).collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")), r
    none = op7_language.fit(empty)
    assert {r["lang_pred"] for r in op7_language.predict(odd, none).collect()} == {"und"}
    assert op7_language.predict(empty, model).count() == 0
    one = op7_language.fit(docs.where("lang = 'de'"), max_rows=50)
    assert {r["lang_pred"] for r in op7_language.predict(some, one).collect()} == {"de"}
    words = op7_language.codewords(9)
    assert len({w.tobytes() for w in words}) == 9


def brute7(model, text):
    """The nearest codeword by plain loops."""
    if not any(unicodedata.category(c)[0] == "L" for c in text or "") or not model.languages:
        return "und", 0.0
    b = b" " + bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in text.lower().encode("utf-8", "replace")) + b" "
    codes = [int.from_bytes(b[i:i + 3], "big") for i in range(len(b) - 2) if b[i:i + 3] != b"   "]
    slots = [c * 2654435761 % 2**32 >> (32 - op7_language.BITS) for c in codes]
    losses = []
    for i in range(len(model.languages)):
        loss = 0.0
        for j, w in enumerate(model.weights):
            margin = sum(float(model.table[s, j]) for s in slots) / max(1, len(slots)) ** 0.5
            x = -int(model.code[i, j]) * margin
            loss += w * (max(x, 0.0) + math.log1p(math.exp(-abs(x))))
        losses.append(loss)
    best = losses.index(min(losses))
    return model.languages[best], 1 / sum(math.exp(min(losses) - x) for x in losses)


def test_language_brute(spark, some, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op7_language.fit(docs, max_rows=200)
    for df in (odd, some):
        for r in op7_language.predict(df, model).collect():
            lang, score = brute7(model, r["text"])
            assert (r["lang_pred"], round(r["score"], 6)) == (lang, round(score, 6))


def test_language_classes(spark):
    """No letter, whatever kind of character else; ties; text in no learned language; rare languages teach too."""
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for c in every:
        assert op7_language.has_letter(c) == (unicodedata.category(c)[0] == "L"), hex(ord(c))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op7_language.fit(docs)
    judge = op7_language.make(model)()
    assert judge(["½ ² ①", "Ⅷ", "१२", "123 !?", "_"]) == [("und", 0.0, True)] * 5
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("qxzjkvwy") for _ in range(6)) for _ in range(3000))
    greek = "και το να του η της με που την από για είναι σε δεν στο " * 200
    assert judge([noise])[0][2] and judge([greek])[0][2]
    assert sum(x[2] for x in judge([r["text"] for r in docs.where("length(text) > 300").collect()])) <= 3
    rows = [(i, "alpha beta gamma", "aa") for i in range(300)] + [(1000 + i, "xylo phon zeta", "bb") for i in range(4)]
    rare = op7_language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_rows=20)
    assert rare.languages == ["aa", "bb"]
    same = op7_language.fit(spark.createDataFrame([(i, "one text", "ab"[i % 2]) for i in range(40)], "doc_id bigint, text string, lang string"))
    same.table[:] = 0
    lang, score, odd = op7_language.make(same)()(["one text"])[0]
    assert (lang, score, odd) == ("a", 0.5, True)


def reference8():
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(op8_bpe.vocabulary())
    ref.no_truncation()
    ref.no_padding()
    return ref


def test_bpe_code_points():
    """Every code point alone, and random mixtures of all kinds."""
    ref, encoder = reference8(), op8_bpe.Encoder(open(op8_bpe.vocabulary(), encoding="utf-8").read())
    every = [chr(c) for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    lines = [f"a{c}b {c}" for c in every]
    for line, e in zip(lines, ref.encode_batch(lines, add_special_tokens=False), strict=True):
        assert encoder.encode(line) == e.ids, line.encode("unicode_escape")
    rng = random.Random(9)
    pick = lambda: chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(1, 0x3000), rng.randrange(1, 0xD800), rng.randrange(0x10000, 0x1F000)]))
    lines = ["".join(pick() for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for line, e in zip(lines, ref.encode_batch(lines, add_special_tokens=False), strict=True):
        assert encoder.encode(line) == e.ids and encoder.decode(e.ids) == ref.decode(e.ids, skip_special_tokens=False)


def test_bpe_settings():
    import json

    spec = json.load(open(op8_bpe.vocabulary(), encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    with pytest.raises(ValueError, match="normalizer"):
        op8_bpe.Encoder(json.dumps(spec))


def test_bpe(spark, some, odd, empty):
    path, ref = op8_bpe.vocabulary(), reference8()
    for docs in (odd, some):
        for r in op8_bpe.encode(docs, path).collect():
            ids = ref.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["token_ids"] == ids, r["text"]
            assert r["decoded"] == ref.decode(ids, skip_special_tokens=False)
            assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
            assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert op8_bpe.digest(empty, path).count() == 0
    encoder = op8_bpe.Encoder(open(path, encoding="utf-8").read())
    for word in [b"a" * 60, b"abcabcabc" * 20, "déjàvu".encode() * 9, b"thththinininan"]:
        parts = [encoder.first[b] for b in word[:-1]] + [encoder.last[word[-1]]]
        assert encoder.merge_short(parts[:]) == encoder.merge_long(parts[:])
        assert encoder.decode(encoder.encode(word.decode())) == ref.decode(ref.encode(word.decode(), add_special_tokens=False).ids, skip_special_tokens=False)


def test_token_counts(spark, some, odd, empty):
    from tokenizers import Tokenizer, models, normalizers

    vocabulary = op10_tokens.load(op10_tokens.vocabulary())
    ref = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    ref.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    for docs in (odd, some):
        for r in op10_tokens.count_tokens(docs, vocabulary).collect():
            assert r["n_tokens"] == len(ref.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]
    assert op10_tokens.count_tokens(empty, vocabulary).count() == 0
    rng = random.Random(4)
    bits = ["<unk>", "<s>", "</s>", "<0x0A>", "\n", " ", "▁", "é", "日本", "😀", "the", "ab", "\x01", "<unk", "unk>", "<", "𝔘"]
    counter = op10_tokens.Counter(vocabulary)
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for line, e in zip(lines, ref.encode_batch(lines, add_special_tokens=False), strict=True):
        assert counter.count(line)[0] == len(e.ids), line
    # words alone and the text at once have the same best score
    small = [("<unk>", 0.0), ("▁a", -1.0), ("b", -1.5), ("▁ab", -2.5), ("ab", -2.0), ("a", -0.5)]
    split, whole = op10_tokens.Counter(small), op10_tokens.Counter([*small, ("b▁q", -2.5)])
    for text in ["ab ab", "aab x", "b  a", "xx\nab"]:
        assert split.count(text) == whole.count(text)
