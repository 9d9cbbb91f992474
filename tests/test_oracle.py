"""Every registered query with an oracle gives the oracle's rows at sf0.01: names, counts and values."""

import glob
import math
import os

import duckdb
import pytest

from siltmill.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"create view {name} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("\x1f".join(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
