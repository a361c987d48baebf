"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; one binary classifier over hashed byte 3-grams predicts each bit. A bit's
classifier is a naive Bayes log-odds table of the languages on its two sides, weighted by how well it separates the
training rows. Decoding takes the codeword of the least weighted logistic loss. A text is flagged as ambiguous if its best
codeword is hardly nearer than the next, or if it fits that codeword badly: shares say nothing on a long text in no learned
language, so its evidence a gram must also be MIN_FIT of what the language's training rows have on average.

Training reads a bounded sample of the labelled rows, whole texts: about max_rows of them in equal parts by language (all
rows of a rarer one), chosen by a hash of the id, and staged.
Only rows with a language, an id and crc32(id as text) mod 4 other than 2 teach. Predictions see nothing but the text.

Null text and text without a letter (Unicode category L): `und`, score 0. Of languages of equal loss, the first by name. A text
of any length is one row of a block of its own if need be. A row without an id is held out. With one language in the training
rows, that is the prediction; with none, `und`. Repeated rows are predicted alike. Columns that clash give way.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_texts, quoted, stage

BITS = 15
MAX_ROWS = 4000
#: A best share below the first, or a lead below the second, is ambiguous.
MIN_SCORE, MIN_LEAD = 0.34, 0.02
#: A text with less than this share of its language's mean evidence a gram is ambiguous too.
MIN_FIT = 0.2
UNKNOWN = "und"

#: ASCII letters in lower case and bytes beyond ASCII stay; all else is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def grams(text: str) -> np.ndarray:
    """Hashes of the byte 3-grams of the folded text, spaces before and behind it; those of three spaces don't count."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(FOLD) + b" ", dtype=np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    code = code[(code != 0x202020)]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def codewords(n: int) -> np.ndarray:
    """n codewords: all splits for up to 6 languages, else random ones of 8 log2 n bits, from a fixed seed."""
    if n < 2:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 6:
        return np.array([[1 if i == 0 or (split >> (i - 1)) & 1 else -1 for split in range(2 ** (n - 1) - 1)] for i in range(n)], dtype=np.int8)
    rng = np.random.default_rng(7)
    width = 8 * math.ceil(math.log2(n))
    while True:
        m = np.where(rng.random((n, width)) < 0.5, 1, -1).astype(np.int8)
        if len({r.tobytes() for r in m}) == n and (np.abs(m.sum(axis=0)) < n).all():
            return m


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages, self.code = languages, codewords(len(languages))
        shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if languages else counts
        columns = []
        for bit in self.code.T:
            yes, no = shares[bit > 0].mean(axis=0), shares[bit < 0].mean(axis=0)
            columns.append(np.log(yes) - np.log(no))
        self.table = np.array(columns, dtype=np.float32).T.copy() if columns else np.zeros((1 << BITS, 0), np.float32)
        self.weights = np.ones(self.code.shape[1])
        self.fits = np.zeros(len(languages))  # the mean evidence a gram of each language's training rows

    def margins(self, text: str) -> tuple[np.ndarray, int] | None:
        """A value for each bit, the sum of the grams' log-odds by the root of their number, and that number; None without a letter."""
        if not has_letter(text):
            return None
        g = grams(text)
        return self.table[g].sum(axis=0, dtype=np.float64) / math.sqrt(max(1, len(g))), max(1, len(g))

    def fit(self, margins: np.ndarray, n: int, i: int) -> float:
        """Evidence a gram for language i: the bits' mean log-odds on its side, weighted."""
        return float((self.code[i] * margins) @ self.weights) / math.sqrt(n)

    def decode(self, margins: np.ndarray, n: int) -> tuple[str, float, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.logaddexp(0, -self.code * margins) @ self.weights
        share = np.exp(-(loss - loss.min()))
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        best = float(share[order[0]])
        bad = self.fit(margins, n, order[0]) < MIN_FIT * self.fits[order[0]]
        return self.languages[order[0]], best, bool(bad or best < MIN_SCORE or best - share[order[1]] < MIN_LEAD)


def _arrow_counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.bincount(grams(text), minlength=1 << BITS)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())})


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    rows = docs.select(quoted(lang).alias("lang"), quoted(text).alias("text"), quoted(doc_id).alias("id")).where(
        ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the number of languages is that of the model's codewords, however many rows there are
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota, left = {}, max_rows
    for i, (name, n) in enumerate(sorted(totals.items(), key=lambda x: x[1])):  # what a rare language leaves, the others share
        quota[name] = min(n, left // (len(totals) - i))
        left -= quota[name]
    if sum(quota.values()) < sum(totals.values()):
        bound = F.create_map(*[x for k in sorted(totals) for x in (F.lit(k), F.lit(int(quota[k] / totals[k] * (1 << 30))))])
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound[F.col("lang")])
    sample = stage(rows.select("lang", "text")).coalesce(16)  # so that 16 tables a language reach the driver at most
    found: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(_arrow_counts, "lang string, counts binary").collect():
        found[r["lang"]] = found.get(r["lang"], 0) + np.frombuffer(r["counts"], dtype="<i8")
    languages = sorted(found)
    model = Model(languages, np.array([found[x] for x in languages], dtype=np.float64).reshape(len(languages), 1 << BITS))
    if len(languages) > 1:
        code = model.code

        def errors(batches: Iterator) -> Iterator:
            import pyarrow as pa

            # of each language: rows, rows that each bit has right, and each bit's mean log-odds a gram on its side
            sums = np.zeros((len(languages), 1 + 2 * code.shape[1]))
            for batch in batches:
                for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if (m := model.margins(t)) is not None:
                        i = languages.index(l)
                        side = m[0] * code[i]
                        sums[i] += np.r_[1, side > 0, side / math.sqrt(m[1])]
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))})

        got = sum((np.array(r["sums"]) for r in sample.mapInArrow(errors, "sums array<double>").collect()), np.zeros(len(languages) * (1 + 2 * code.shape[1])))
        n, right, side = np.split(got.reshape(len(languages), -1), [1, 1 + code.shape[1]], axis=1)
        accuracy = np.clip(right.sum(axis=0) / max(1, n.sum()), 0.5, 0.999)
        model.weights = np.log(accuracy / (1 - accuracy)) + 1e-3
        model.weights /= model.weights.mean()
        model.fits = side @ model.weights / np.maximum(1, n[:, 0])
    return model


def make(model: Model) -> Callable[[], Callable[[list], list[tuple]]]:
    def start():
        def one(text: str | None) -> tuple[str, float, bool]:
            margins = None if text is None or not model.languages else model.margins(text)
            return (UNKNOWN, 0.0, True) if margins is None else model.decode(*margins)

        return lambda texts: [one(t) for t in texts]

    return start


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    return map_texts(docs, make(model), T._parse_datatype_string("lang_pred string, score double, ambiguous boolean"), text)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
