import duckdb
import pytest

from mentionflow.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(columns, got):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple((r[i] is None, str(round(r[i], 6) if isinstance(r[i], float) else r[i])) for i in order) for r in got)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "events", "documents", "embeddings", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
