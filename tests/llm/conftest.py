import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SAMPLE = "/root/testdata/sf0.001"

ODD = [
    None, "", " ", "\n\n", "a", "A b\tc\x0bd", "x " * 300, "the the the the the the", "it's we'll I'm 12 ½ ३ Ⅷ",
    "Σίσυφος ΟΔΟΣ İstanbul été ́x 日本語 😀😀", "a\x1cb\x85c　d e", "pre<|endoftext|>mid <|startoftext|><|endoftext", "#$%&*|<> ### one",
    "z" * 700, "é" * 400, "<s> <0x41> ▁▁ a  b   c", "one two three four five six seven eight nine ten\none two three four five six seven eight nine ten",
    "l1 a b\nl2 c d\nl3\nl1 a b\nl2 c d\nl3", "\r\n mixed\r\nlines \n",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows and clashing columns."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    rows += [(3, "again with id three", "fr", "s", 1), (None, "no id here at all", None, None, None), (None, "no id here at all", None, None, None), (4, "a", "en", "s", 1), (4, "a", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    return spark.read.parquet(f"{SAMPLE}/documents.parquet").limit(80).repartition(4)
