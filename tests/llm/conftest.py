import pytest

LONG = "lorem ipsum dolor " * 20_000 + "x" * 70_000


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, ties, repeats, and extra columns whose names operators use themselves."""
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, LONG, "en", "a", len(LONG)), (4, "Same words here, four of them.", "de", "b", 5), (5, "Same words here, four of them.", "de", "b", 5),
        (5, "Same words here, four of them.", "de", "b", 5), (None, "no id at all", "fr", None, 3), (6, " \n\t ", "en", "", 4), (7, "one", None, "a", 3), (8, "é日本😀 \x00\x1c ok", "xx", "a", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.selectExpr("*", *[f"'clash' as {c}" for c in ("size", "digest", "shard", "n", "token", "pivot", "score", "label", "votes", "norm", "words", "spans", "bits", "prefix", "mix_source", "weight", "copy_id", "toxic")])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
