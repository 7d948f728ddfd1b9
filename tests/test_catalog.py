import glob
import os

import pytest

from noticiario.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, duck, name, tmp_path):
    df = QUERIES[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    cols = ", ".join(df.columns)
    mine = f"(select {cols} from '{tmp_path}/out/*.parquet')"
    theirs = f"(select {cols} from ({ORACLE[name]}))"
    assert duck.execute(f"select count(*) from (select * from {mine} except all select * from {theirs})").fetchall() == [(0,)]
    assert duck.execute(f"select count(*) from (select * from {theirs} except all select * from {mine})").fetchall() == [(0,)]
