import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, component_id string, hit_spans string, score string, kind string"
LONG = " ".join(f"w{i % 7919}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 5}" for i in range(60))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    texts = [None, "", "   \n\t ", "one two", "One TWO", "a b c d e", BASE, BASE, BASE.replace("alpha7 ", "gamma "), LONG, LONG + " tail", "12345 67890 !!!", "Straße ñandú über 日本語 текст", "x" * 50_000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None, 9, 9, "c", "h", "s", "k") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, "one two", None, None, None, 1, 1, "c", "h", "s", "k"), (None, None, None, None, None, 1, 1, "c", "h", "s", "k")]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
