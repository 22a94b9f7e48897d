"""Every query that has SQL, against DuckDB on the same tables; the others must run."""

import math

import pytest

from tidemark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)[:10] if hasattr(v, "year") else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    mine = rows(found.columns, [tuple(r) for r in found.collect()])
    cursor = duck.execute(SQL[name])
    theirs = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
