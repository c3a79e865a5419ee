"""Every registered query against its SQL, both over whole tables."""

import duckdb
import pytest

from corpuslens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, db, tmp_path):
    path = str(tmp_path / "out")
    catalog.QUERIES[name](spark, SF).write.parquet(path)
    got = f"(select * from read_parquet('{path}/*.parquet'))"
    rows = db.execute(f"select count(*) from {got}").fetchall()[0][0]
    assert rows > 0
    if name not in catalog.ORACLE:
        return
    db.execute(f"create or replace table want as {catalog.ORACLE[name]}")
    columns = sorted(r[0] for r in db.execute("describe want").fetchall())
    assert columns == sorted(r[0] for r in db.execute(f"describe select * from {got}").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in ((got, "want"), ("want", got)):
        assert db.execute(f"select {listed} from {a} except all select {listed} from {b}").fetchall() == []


def test_names_have_no_sql_left_over():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
