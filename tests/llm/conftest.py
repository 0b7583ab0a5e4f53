import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

#: Texts with which every operator over documents must cope.
ODD = [
    (1, "plain words stand here and there", "en", "s", 32),
    (1, "plain words stand here and there", "en", "s", 32),  # a repeated row
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \n\t ", "en", "s", 4),
    (5, "word", "en", "s", 4),
    (6, "a b c " * 60_000, "en", "s", 360_000),  # very long
    (7, "x" * 200_000, "en", "s", 200_000),  # one very long word
    (8, "Ünï cödé \x00 \x1c <|endoftext|> \\ 日本語 テスト", "xx", "s", 40),
    (None, "a row without an id", "en", "s", 19),
]

#: Names that operators use inside.
CLASHING = ["score", "row", "key", "node", "block", "label", "hits", "words", "ranks", "text_hash", "rank", "segment", "start", "length", "held", "w0", "component_id", "lines_removed", "size", "bucket"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, COLUMNS)
    return frame.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
