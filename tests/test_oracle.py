"""Every registered query of the library gives the rows of its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from laureate.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def _rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(_plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.collect(), df.columns) == _rows(want.fetchall(), names)
