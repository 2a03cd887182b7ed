import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "one two three four five six", "en", "a", 27),
        (2, "one two  three four five six", "en", None, 28),
        (2, "one two  three four five six", "en", None, 28),
        (3, None, None, "b", None),
        (4, "", None, "b", 0),
        (None, "nothing has this id", "en", "a", 19),
        (5, " \t\n", "en", "a", 3),
        (6, "lang " * 30_000, "en", "c", 150_000),
        (7, "12345 !!!", "en", "c", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "'x' as sha", "1 as node", "2 as size", "'y' as block", "3 as shard", "4 as label", "'z' as spans")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
