import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """Writes rows as the documents table of a folder of its own and returns its path."""

    def write(rows, schema="doc_id long, text string, lang string, source string, n_chars long", name="documents"):
        path = str(tmp_path_factory.mktemp("sf"))
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
        return path

    return write
