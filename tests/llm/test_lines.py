import hashlib
import random
from collections import Counter

import pytest
import xxhash

from kgloom.llm import op2_lines


def brute(rows, k):
    """(id, lines with a word, lines removed, longest run of a source, kept text): every run of k lines that starts earlier too goes. A place's
    source is the first of the places that share k, 2k, 4k ... lines with it, at the deepest of these where it isn't first itself."""
    docs = [(r["doc_id"], None if r["text"] is None else r["text"].split("\n"), xxhash.xxh64(r["text"] or "", seed=42).intdigest()) for r in rows]
    docs = [(d, x, h - (1 << 64 if h >> 63 else 0), [i for i, l in enumerate(x or []) if l.strip(" \t\n\x0b\x0c\r")]) for d, x, h in docs]
    at = lambda d, i: (d is None, d or 0, i)
    gone, source = [set() for _ in docs], {}
    depth = k
    while any(depth <= len(w) for _, _, _, w in docs):
        first = {}
        for n, (d, x, h, w) in enumerate(docs):
            for i in range(len(w) - depth + 1):
                key = tuple(x[j] for j in w[i:i + depth])
                first[key] = min(first.get(key, ((2,),)), (at(d, i), h, n))
        for n, (d, x, _, w) in enumerate(docs):
            for i in range(len(w) - depth + 1):
                found = first[tuple(x[j] for j in w[i:i + depth])]
                if found[0] < at(d, i):
                    source[n, i] = found
                    if depth == k:
                        gone[n] |= set(w[i:i + depth])
        depth *= 2
    longest = [0] * len(docs)
    for (n, i), ((_, _, j), _, m) in source.items():
        (_, x, _, w), (_, y, _, v) = docs[n], docs[m]
        agree = 0
        while i + agree < len(w) and j + agree < len(v) and x[w[i + agree]] == y[v[j + agree]]:
            agree += 1
        longest[n] = max(longest[n], agree)
    return Counter((d, len(w), len(g), deep, None if x is None else "\n".join(l for i, l in enumerate(x) if i not in g)) for (d, x, _, w), g, deep in zip(docs, gone, longest, strict=True))


def result(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["lcp_lines"], r["kept_text"]) for r in df.collect())


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 2), (3, 3), (4, 5)])
def test_lines(spark, seed, k):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", "", " ", "e"]) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(None, rows[0][1]), (5, rows[6][1]), (5, rows[5][1]), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(op2_lines.dedup(docs, min_lines=k)) == brute(docs.collect(), k)


@pytest.mark.parametrize("k", [1, 3])
def test_runs_of_many_lengths(spark, k):
    """Runs of 1 to 20 lines shared by documents, a hot line, and a copy of a long document."""
    rng = random.Random(7)
    run = [f"run line {i}" for i in range(20)]
    rows = []
    for n in range(1, 21):
        lo = rng.randint(0, 20 - n)
        rows.append((n, "\n".join([f"own {n} a", *run[lo:lo + n], "hot", f"own {n} b", "hot"])))
    long = "\n".join(f"chapter {i} line" for i in range(150))
    rows += [(100, long), (101, "x\n" + long), (102, long + "\nhot")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = result(op2_lines.dedup(docs, min_lines=k))
    assert got == brute(docs.collect(), k)
    assert {r[3] for r in got} >= {150}


def test_runs(spark):
    """Runs have a start, an exact length and a source; one line many times is a run for each place, and each line goes once."""
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\n\nd\ny\na\nb"), (3, "\n".join(["z"] * 40)), (4, "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = {(r["id"], r["idx"], r["length"], r["first"]["id"], r["first"]["idx"]) for r in op2_lines.runs(docs).collect()}
    assert {r for r in got if r[0] == 2} == {(2, 1, 3, 1, 1), (2, 5, 2, 1, 0)}
    assert {r for r in got if r[0] == 3} == {(3, i, 40 - i, 3, 0) for i in range(1, 40)}
    assert {r[0] for r in got} == {2, 3} and result(op2_lines.dedup(docs)) == brute(docs.collect(), 1)
    got = {(r["id"], r["idx"], r["length"]) for r in op2_lines.runs(docs, min_lines=3).collect()}
    assert {r for r in got if r[0] == 2} == {(2, 1, 3)} and op2_lines.runs(docs, min_lines=50).count() == 0


def test_lines_odd(odd, some, empty):
    for docs in (odd, some):
        assert result(op2_lines.dedup(docs)) == brute(docs.collect(), 1)
    assert op2_lines.dedup(empty).count() == 0


def test_clashing_and_long(spark):
    """Columns that clash give way, others stay; a text of some MB is one row."""
    line = lambda i: f"line {i} of a long text" + " and more" * 90
    big = "\n".join(line(i % 2400) for i in range(2700))
    docs = spark.createDataFrame([(1, big, 5, "k", "o"), (2, line(7) + "\nown", 6, "k", "p")], "doc_id bigint, text string, N_LINES bigint, _gone string, other string")
    got = {r["doc_id"]: r for r in op2_lines.dedup(docs).collect()}
    assert (got[1]["n_lines"], got[1]["n_removed"], got[2]["n_removed"], got[2]["kept_text"]) == (2700, 300, 1, "own")
    assert got[1]["lcp_lines"] == 300 and {r["other"] for r in got.values()} == {"o", "p"}


def test_single_lines_go(spark, tmp_path):
    """A shared passage between lines of its own, and exact copies of one-line documents."""
    import __spark_entry__ as entry

    rows = [(0, "own a\nshared passage\nown b", "en"), (1, "own c\n\nshared passage\nown d", "en"), (2, "one line only", "en"), (3, "one line only", "en"), (4, None, "en"), (5, "z\nz", "en")]
    d = str(tmp_path)
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = {(i, n, k, p, sha(t)) for i, n, k, p, t in brute([{"doc_id": r[0], "text": r[1]} for r in rows], 1)}
    got = {tuple(r) for r in entry.queries()["op2_line_dedup"](spark, d).select("doc_id", "n_lines", "n_removed", "lcp_lines", "kept_sha256").collect()}
    assert got == want and {(r[0], r[2]) for r in got if r[2]} == {(1, 1), (3, 1), (5, 1)}
