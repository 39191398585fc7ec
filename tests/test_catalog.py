"""Every driver query against its SQL, and column functions against the worker's forms."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from platterlake.functions import columns as C
from platterlake.plans.catalog import ORACLE_SQL, QUERIES
from platterlake.sources import filecore as fc
from platterlake.sources.model import text


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    rows = lambda names, got: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in got)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_columns_equal_worker_forms(spark):
    data = [bytes((i * k + 7 * k) & 255 for i in range(512)) for k in range(1, 9)]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "d binary")
    got = df.select("d", C.zone_check(F.col("d")), C.boot_checksum(F.col("d")), C.dir_checksum(F.col("d")), C.charset(F.col("d"))).collect()
    for d, zone, boot, check, chars in got:
        assert (zone, boot) == (fc.zone_check(bytes(d)), fc.boot_check(bytes(d)))
        assert check == fc.dir_check(fc.words_then_bytes(bytes(d))) and chars == text(bytes(d))
