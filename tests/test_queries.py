"""Every named query with SQL equals DuckDB's answer; the rest hold their invariants (test_walks.py, test_sources.py)."""

import pytest
from conftest import DATA

from tesselark.plans import catalogue


def native(v):
    """A value in a form that both engines share; nullable integers stay integers, unlike in pandas."""
    if isinstance(v, (list, tuple)):
        return [native(x) for x in v]
    return round(v, 6) + 0.0 if isinstance(v, float) and v == v else v


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(str(native(r[i])) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, con, name):
    df, other = catalogue.QUERIES[name](spark, DATA), con.execute(catalogue.SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in other.description], other.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
