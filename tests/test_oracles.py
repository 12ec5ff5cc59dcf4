"""Every registered retail query against its SQL on the smallest tables."""

import pytest

from segmentflow.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, views, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    want = sorted(views.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall(), key=str)
    assert got == want
