"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries the
best score and its number of pieces, and no back pointers. Ties are the tokenizer's own: among paths of equal score to
a position, the one whose last piece starts earliest stays, and an unknown character (only where no one-character piece
starts) has the least score of the vocabulary less 10. The unknown piece and unknown characters that follow each other are
one run, as in the tokenizer: it counts one if it is a piece (a literal `<unk>` alone), else its UTF-8 bytes (byte fallback).
The pass carries where the run at its end began, so no path is traced back.

Spaces become U+2581 and one is put before a text that isn't empty. Where that mark is a piece and no piece has it behind
another character (checked when the vocabulary is loaded), a best path is made of best paths of the words, whose counts are
kept in a bounded table; a word that another follows ends its run, as the mark is no unknown.

Null or empty text has no tokens and score 0. Repeated rows count alike. An empty table gives an empty result. Columns
that clash with the results give way.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, map_texts

MARK = "▁"
#: Fixed value: what an unknown character scores below the least score.
UNKNOWN = 10.0
TABLE, TABLE_TEXT = 400_000, 64


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown_id: int | None = 0) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in self.auto:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN
        self.pieces = {p for p, _ in vocabulary}
        self.unknown_piece = vocabulary[unknown_id][0] if unknown_id is not None else None
        inner = MARK not in self.pieces or self.unknown_piece is not None and MARK in self.unknown_piece or any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary)
        self.words = re.compile("(?s).+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.lines = not any("\n" in p for p, _ in vocabulary)  # then a line break is unknown and stands alone
        self.table: dict[str, tuple[int, float]] = {}

    def viterbi(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path through word."""
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for end, (size, score) in self.auto.iter(word):
            ending[end + 1].append((end + 1 - size, score))
            if size == 1:
                single[end] = True
        score, count, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)  # run: where the unknown run at the end began, or -1
        known = self.unknown_piece
        for end in range(1, n + 1):
            best, last = None, 0
            for start, s in sorted(ending[end]):
                if best is None or score[start] + s > best:
                    best, last = score[start] + s, start
            odd = known is not None and best is not None and word.startswith(known, last) and end - last == len(known)
            if not single[end - 1] and (best is None or score[end - 1] + self.unknown > best):
                best, last, odd = score[end - 1] + self.unknown, end - 1, True
            score[end] = best
            if odd:
                count[end], run[end] = count[last], last if run[last] < 0 else run[last]
            else:
                count[end] = count[last] + self.closed(word, run[last], last) + 1
        return count[n] + self.closed(word, run[n], n), score[n]

    def closed(self, word: str, start: int, end: int) -> int:
        """What an unknown run counts."""
        return 0 if start < 0 else 1 if word[start:end] in self.pieces else len(word[start:end].encode())

    def of(self, word: str) -> tuple[int, float]:
        found = self.table.get(word)
        if found is None:
            found = self.viterbi(word)
            if len(word) <= TABLE_TEXT:
                if len(self.table) >= TABLE:
                    self.table.clear()
                self.table[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        # a line break stands alone, unless the unknown piece is there to join it
        parts = marked.split("\n") if self.lines and not (self.unknown_piece and self.unknown_piece in text) else [marked]
        n, score = len(parts) - 1, (len(parts) - 1) * self.unknown
        for part in parts:
            for word in self.words.findall(part):
                a, b = self.of(word)
                n += a
                score += b
        return n, score


def load(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, read as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def make(vocabulary: list[tuple[str, float]]) -> Callable[[], Callable[[list], list[tuple]]]:
    def start():
        counter = Counter(vocabulary)
        return lambda texts: [(len(t or ""), *counter.count(t)) for t in texts]

    return start


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text") -> DataFrame:
    """docs with n_chars, n_tokens and best_score of every whole text. The vocabulary travels with the function."""
    return map_texts(docs, make(vocabulary), T._parse_datatype_string("n_chars bigint, n_tokens bigint, best_score double"), text)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), load(vocabulary())).drop("text")
