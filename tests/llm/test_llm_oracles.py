"""Every query of the training-data operators that has SQL equals it on the smallest tables."""

import pytest
from test_oracles import SF, duck, normal  # noqa: F401

from glyphlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.execute(queries.oracle_sql()[name])
    assert sorted(c[0] for c in told.description) == columns
    order = [[c[0] for c in told.description].index(c) for c in columns]
    assert normal(df.select(*columns).collect()) == normal([tuple(r[i] for i in order) for r in told.fetchall()])
