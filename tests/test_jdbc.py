"""Reads over JDBC in even parts (Derby, in this JVM)."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitemporal as B
from tidemark.sources import ingest

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
TYPES = {"createTableColumnTypes": "namespace VARCHAR(40), instrument_id VARCHAR(40)"}  # Derby has no order of texts without a length
SCHEMA = "namespace string, instrument_id string, vt date, kt date, revision int, value double"


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def sizes(frame):
    return frame.groupBy(F.spark_partition_id().alias("p")).count().select("count").toPandas()["count"].tolist()


def test_skewed_keys_make_even_parts(spark, url):
    """A key with two thirds of all rows, one with a quote in it, nulls: every row once, parts within twice the even share."""
    keys = ["hot"] * 600 + [f"k'{k % 90:02}" for k in range(270)] + ["z"] * 30
    rows = spark.createDataFrame([("bar", key, None if k % 10 == 0 else day(k % 200), day(k % 200 + k % 3), k, k / 4) for k, key in enumerate(keys)], SCHEMA)
    ingest.write_jdbc(rows.coalesce(1), url, "records", **DRIVER, **TYPES)
    found = ingest.read_jdbc_evenly(spark, url, "records", ["instrument_id", "vt", "revision"], 9, **DRIVER)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.collect()))
    assert 9 <= found.rdd.getNumPartitions() <= 18 and max(sizes(found)) <= 2 * 900 / 9
    plain = ingest.read_jdbc(spark, url, "records", "vt", str(day(0)), str(day(2000)), 9, **DRIVER)
    assert max(sizes(plain)) > 4 * 900 / 9  # bounds that don't fit the data


def test_as_of_over_jdbc(spark, url):
    rows = spark.createDataFrame([("bar" if k % 3 else "macro", f"i{k % 7}", day(k % 20), day(k % 20 + r), r, k + r / 10) for k in range(140) for r in range(3)], SCHEMA)
    ingest.write_jdbc(rows.coalesce(1), url, "records", **DRIVER, **TYPES)
    found = B.as_of(ingest.read_jdbc_evenly(spark, url, "records", ["vt", "instrument_id"], 4, **DRIVER), F.lit(day(12)), "bar", vt_start=day(3))
    want = B.as_of(rows, F.lit(day(12)), "bar", vt_start=day(3))
    keyed = lambda frame: sorted((r["instrument_id"], r["vt"], r["revision"]) for r in frame.collect())
    assert keyed(found) == keyed(want) and len(keyed(want)) > 20
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    pushed = B.as_of(ingest.read_jdbc_evenly(spark, url, "records", ["vt"], 2, **DRIVER), F.lit(day(12)), "bar", vt_start=day(3))._jdf.queryExecution().executedPlan().toString()
    assert all(part in pushed for part in ("*LessThanOrEqual(kt,2024-01-13)", "*EqualTo(namespace,bar)", "*GreaterThanOrEqual(vt,2024-01-04)")), pushed
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_odd_tables(spark, url):
    none = spark.createDataFrame([], SCHEMA)
    ingest.write_jdbc(none, url, "nothing", **DRIVER, **TYPES)
    assert ingest.read_jdbc_evenly(spark, url, "nothing", ["vt"], 5, **DRIVER).collect() == []
    nulls = spark.createDataFrame([("bar", "a", None, day(1), None, float(k)) for k in range(10)], SCHEMA)
    ingest.write_jdbc(nulls, url, "nulls", **DRIVER, **TYPES)
    assert ingest.read_jdbc_evenly(spark, url, "nulls", ["revision", "vt"], 5, **DRIVER).count() == 10
    same = spark.createDataFrame([("bar", "a", day(1), day(1), 0, 1.0)] * 10, SCHEMA)
    ingest.write_jdbc(same, url, "same", **DRIVER, **TYPES)
    assert ingest.read_jdbc_evenly(spark, url, "same", ["instrument_id", "vt", "revision"], 5, **DRIVER).count() == 10
