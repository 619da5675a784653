"""Every registered query against its oracle on the smallest tables."""

import pytest

from tracewright.plans import catalog

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def rows(values):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in row] for row in values), key=repr)


def compared(spark, duck, data, queries, oracles, name):
    df = queries[name](spark, data)
    result = duck.execute(oracles[name])
    types = {d[0]: str(d[1]) for d in result.description}
    order = sorted(df.columns)
    assert order == sorted(types)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    at = [list(types).index(c) for c in order]
    assert rows([r[c] for c in order] for r in df.collect()) == rows([r[k] for k in at] for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_its_oracle(spark, duck, data, name):
    compared(spark, duck, data, catalog.queries(), catalog.oracles(), name)


def test_every_oracle_has_a_query():
    assert set(catalog.oracles()) <= set(catalog.queries())


def test_learned_verifier_reports(spark, data):
    row = catalog.queries()["learned_verifier"](spark, data).first()
    assert row["n"] > 0 and 0 <= row["brier"] <= 1
