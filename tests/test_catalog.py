"""Every registered query of the library against its SQL."""

import datetime
import decimal
import os

import duckdb
import pytest

from quern import catalog


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = duck.sql(catalog.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in cols]
    assert len(found.columns) == len(cols)
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_error_pairs_round_seconds(spark, tmp_path, zone):
    """Fractions of seconds at both ends of the band, halves, times before the epoch and an hour that a zone skips."""
    times = ["2024-01-01 00:00:00.6", "2024-01-01 00:00:01.4", "2024-01-01 00:00:02.5", "2024-01-01 02:00:00.5", "2024-01-01 02:00:01.5", "2024-01-01 02:00:02.499999",
             "2024-03-10 01:30:00", "2024-03-10 02:45:00.2", "2024-03-10 03:30:00.9", "1969-12-31 22:00:00.3", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00.5"]
    duckdb.sql(f"copy (select i as event_id, t::timestamp as ts, 1::bigint as user_id, 'error' as event_type, 0.0::double as value, '' as props from (select unnest({times!r}) as t, unnest(range({len(times)})) as i)) to '{tmp_path}/events.parquet'")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = sorted(tuple(r) for r in catalog.error_pairs(spark, str(tmp_path)).select("u", "e1", "e2").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == sorted(c.sql(catalog.ORACLE_SQL["error_pairs"]).fetchall())
