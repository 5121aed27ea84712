import datetime
import decimal
import math

import duckdb
import pytest

from lakewatch import entries
from tests.conftest import SF

SMALL = SF.replace("0.01", "0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return int(v) if isinstance(v, float) and not math.isnan(v) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_query(spark, duck, name):
    df = entries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in entries.ORACLE_SQL:
        return
    cur = duck.execute(entries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows) == want
