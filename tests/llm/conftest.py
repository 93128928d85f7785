import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, _size long, cell int, `a.b` string, docs long, target double, _tier int, _shard string, _hits string, _step int, node long, position long"
REST = ("x", 1, 2.0, 3, "s", "y", 4, 5, 6)
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree by the river and count the stars "


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    columns whose names operators use themselves.
    """
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    texts = [None, "", " \n\t ", BASE, BASE, BASE + "again", BASE.upper(), long, "ünïcödé 文字 слово " * 5, "one", "one two", "a\nb\n\na", "\0nul", "x" * 5000]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], i, 0.5, "h", 7, 1, *REST) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (11, "another text of one id", "de", "b", 1, 0.5, "h", 7, 1, *REST), (None, BASE, "en", "a", 1, *[None] * 13), (None,) * 18]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), DOC).repartition(3).write.parquet(path + "/d")
    return spark.read.parquet(path + "/d")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
