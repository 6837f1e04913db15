"""Every registered query with an oracle matches DuckDB at sf0.001; the
others run and return rows with a stable schema."""

import decimal
import datetime as dt

import pytest

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


def _norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return format(float(v), ".9g")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticket_date", "category", "priority", "ticket_count", "open_count",
                          "resolved_count", "avg_resolution_minutes"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMOKE)
    rows, cols = df.collect(), df.columns
    if name not in ORACLE:
        assert len(cols) == len(set(cols))
        return
    cur = duck.execute(ORACLE[name])
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    assert sorted(cols) == sorted(o_cols)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    o_order = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
    a = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in o_order) for r in o_rows)
    assert a == b
