"""Every query of the catalog equals its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import DATA

from glyphlake.plans import catalog

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(flat(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.execute(catalog.oracle_sql()[name])
    assert sorted(c[0] for c in told.description) == columns
    order = [[c[0] for c in told.description].index(c) for c in columns]
    assert normal(df.select(*columns).collect()) == normal([tuple(r[i] for i in order) for r in told.fetchall()])


def test_all_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
