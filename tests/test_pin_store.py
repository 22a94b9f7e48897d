"""Pins of a growing store, against fresh pins of all its rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pins as K
from tidemark.operators.pin_store import PinStore


def rows_of(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("k"), F.col("id") % 50).alias("key"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("value"))


def one(frame):
    return tuple(frame.select("pin", "n").first())


@pytest.fixture
def store(spark, tmp_path):
    s = PinStore(spark, f"pins_{uuid.uuid4().hex}", prefix=3, buckets=4, path=str(tmp_path))
    yield s
    s.drop()


def test_pin_after_appends(spark, store):
    """Each batch's pin is a fresh pin of all rows so far, repeated rows and an empty batch included."""
    parts = [rows_of(spark, 0, 900), rows_of(spark, 900, 905), rows_of(spark, 900, 905), rows_of(spark, 0, 0), rows_of(spark, 905, 3000)]
    so_far, want = None, []
    for k, rows in enumerate(parts):
        assert store.append(rows, k)
        so_far = rows if so_far is None else so_far.unionByName(rows)
        want.append(one(K.snapshot_pin(so_far, prefix=3)))
        assert one(store.pin()) == want[-1]
    assert want[1][1] == 905 and want[2] != want[1] and want[3] == want[2]
    assert [one(store.pin(k)) for k in (0, 1, 2, 4)] == [want[k] for k in (0, 1, 2, 4)]


def test_empty_store(spark, store):
    store.append(rows_of(spark, 0, 0), 0)
    assert one(store.pin()) == one(K.snapshot_pin(rows_of(spark, 0, 0), prefix=3))


def test_only_touched_buckets(spark, store):
    store.append(rows_of(spark, 0, 2000), 1)
    store.append(rows_of(spark, 2000, 2003), 2)
    touched = {r["b"] for r in rows_of(spark, 2000, 2003).select(F.substring(K.row_digest(rows_of(spark, 0, 1)), 1, 3).alias("b")).collect()}
    assert {r["b"] for r in spark.table(store.nodes_table).filter("batch = 2").collect()} == touched
    changed = store.changed(1, 2).collect()
    assert {r["b"] for r in changed} == touched and sum(r["n_after"] - r["n_before"] for r in changed) == 3
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell which buckets are read
    read = spark.table(store.digests_table).filter(F.col("b").isin(list(touched)[:1]))
    assert "SelectedBucketsCount: 1 out of 4" in read._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    plan = store.pin()._jdf.queryExecution().executedPlan().toString()
    assert store.digests_table.split(".")[-1] not in plan and plan.count("Exchange") == 2  # of bucket digests and of 256 of them, none by bucket


def test_repeated_and_failed_batches(spark, store):
    store.append(rows_of(spark, 0, 100), 1)
    want = one(store.pin())
    assert not store.append(rows_of(spark, 0, 100), 1) and one(store.pin()) == want
    store._save(rows_of(spark, 5000, 5100).select(F.lit("abc").alias("b"), F.sha2("key", 256).alias("d")), store.digests_table, 2)  # an append that ended before its nodes
    assert one(store.pin()) == want and store.batches() == [1]
    store.append(rows_of(spark, 100, 140), 2)
    assert one(store.pin()) == one(K.snapshot_pin(rows_of(spark, 0, 140), prefix=3))
    with pytest.raises(ValueError, match="comes after"):
        store.append(rows_of(spark, 0, 1), 0)


def test_many_touched_buckets(spark, store, monkeypatch):
    monkeypatch.setattr("tidemark.operators.pin_store.NAMED", 2)
    store.append(rows_of(spark, 0, 300), 1)
    store.append(rows_of(spark, 300, 600), 2)
    assert one(store.pin()) == one(K.snapshot_pin(rows_of(spark, 0, 600), prefix=3))
