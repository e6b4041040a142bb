"""Every registered query of the engine against its SQL, and the driver contract."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from larkspur.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(registry.queries()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_part():
    root = Path(registry.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"import.*llm|from.*llm", f.read_text()), f
