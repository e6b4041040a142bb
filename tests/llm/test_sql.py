"""The operators' SQL, run by DuckDB on the same table."""

import duckdb
import pytest

from larkspur.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(df.select(*columns).collect()) == plain(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
