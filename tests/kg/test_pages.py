"""The page source: ranges in parallel, filters before files are opened, the hook for documents; functions for SQL."""

import pytest
from pyspark.sql import functions as F

from kgloom import sql
from kgloom.functions import scalars as s
from kgloom.sources import files, pages


def stub():
    """A document is a text whose pages are lines. The class is a local one, so that it travels by value."""
    class Slides:
        def accepts(self, name):
            return name.endswith(".slides")

        def count(self, file):
            return file.read().count(b"\n") + 1

        def pages(self, file, first, last):
            for i, line in enumerate(file.read().decode().split("\n"), 1):
                if first <= i <= last:
                    yield i, line, "ocr" if line else "empty"

    return Slides


@pytest.fixture
def books(tmp_path):
    for job, n in (("book", 9), ("leaf", 2)):
        (tmp_path / job).mkdir()
        for i in range(1, n + 1):
            (tmp_path / job / f"page_{i:03}.txt").write_text(" \n" if i == 2 else f"{job} {i}")
    (tmp_path / "talk.slides").write_text("one\n\nthree")
    (tmp_path / "notes.txt").write_text("not a page")
    return f"file://{tmp_path}"


def test_pages(spark, books):
    df = pages.book_pages(spark, books, pages=4)
    assert df.rdd.getNumPartitions() == 4  # three ranges of one book, one of the other
    assert {(r["job_id"], r["page"], r["source"]) for r in df.collect()} == {(j, i, "empty" if i == 2 else "text") for j, n in (("book", 9), ("leaf", 2)) for i in range(1, n + 1)}
    some = df.where("page between 5 and 8 and job_id = 'book'")
    assert some.rdd.getNumPartitions() == 1 and sorted(r["text"] for r in some.collect()) == [f"book {i}" for i in (5, 6, 7, 8)]
    assert {(r["job_id"], r["page"]) for r in df.where("page in (1, 9) and text like '%1'").collect()} == {("book", 1), ("leaf", 1)}
    assert df.where("page > 100").count() == 0
    window = files.page_window(df, 8, 30)
    assert sorted((r["job_id"], r["page"]) for r in window.collect()) == [("book", 8), ("book", 9), ("leaf", 2)]


def test_hook(spark, books):
    df = pages.book_pages(spark, books, stub(), 2).where("job_id = 'talk'")
    assert sorted(tuple(r) for r in df.collect()) == [("talk", 1, "one", "ocr"), ("talk", 2, "", "empty"), ("talk", 3, "three", "ocr")]
    assert [r["page"] for r in df.where("page >= 2 and page < 3").collect()] == [2]


def test_sql(spark):
    sql.register(spark)
    rows = spark.createDataFrame([("Ab （c） d", "abc"), ("", ""), ("循环 语句", "循环"), (None, "x")], "a string, b string")
    rows.createOrReplaceTempView("names")
    got = spark.sql("SELECT a, kg_norm(a) AS n, kg_jaccard(a, b) AS j FROM names").collect()
    want = rows.select("a", s.norm_name(F.col("a")).alias("n"), F.coalesce(s.jaccard_chars(F.col("a"), F.col("b")), F.lit(0.0)).alias("j")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(Exception, match="column source"):
        spark.sql("SELECT * FROM code_patterns(TABLE(SELECT 1 AS x))").collect()
