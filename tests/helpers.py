"""What the tests share."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"


def _plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, int | float) and not isinstance(value, bool) else value


def assert_same(spark_rows, duck, sql):
    """The same rows in any order, columns by name."""
    columns = sorted(spark_rows.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in spark_rows.collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([_plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in result.fetchall())
    assert got == want
