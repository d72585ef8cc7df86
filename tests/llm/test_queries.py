import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(Q.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = Q.queries()[name](spark, SMALL)
    found = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert got == sorted(map(tuple, found.fetchall()), key=key)
