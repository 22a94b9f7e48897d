"""Restatements as they arrive, against batch reads."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import bitemporal as B
from tidemark.streaming.append import record_stream
from tidemark.streaming.restate import restatement_stream, standing

SCHEMA = "namespace string, instrument_id string, vt date, kt date, revision int, value double, note string"
COLUMNS = ["namespace", "instrument_id", "vt", "kt", "revision", "value", "note"]


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def history(seed, n=200):
    rng, out = random.Random(seed), {}
    for _ in range(n):
        key = ("bar", rng.choice("abc"), day(rng.randrange(12)), rng.randrange(5))
        out.setdefault(key, (*key[:3], day(rng.randrange(40)), key[3], rng.choice([None, rng.randrange(9) / 4]), rng.choice([None, "", 'a"b'])))
    rows = list(out.values())
    rng.shuffle(rows)
    return rows


def texts(frame, columns):
    return sorted(map(repr, frame.select(columns).collect()))


def test_standing_is_as_of(spark, tmp_path):
    """Records in any order, some of them twice and some in two batches, end in what a batch read shows; a replay changes nothing."""
    rows = history(3)
    parts = [rows[:60], rows[40:130], rows[130:] + rows[:5], rows]
    counts = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        restatement_stream(record_stream(spark, f"{tmp_path}/landed", spark.createDataFrame([], SCHEMA).schema, "parquet"), ["value", "note"], f"{tmp_path}/changes", f"{tmp_path}/progress").awaitTermination()
        counts.append(spark.read.parquet(f"{tmp_path}/changes").count())
    changes = spark.read.parquet(f"{tmp_path}/changes")
    assert texts(standing(changes), COLUMNS) == texts(B.as_of(spark.createDataFrame(rows, SCHEMA), day(99)), COLUMNS)
    assert counts[-1] == counts[-2] and counts[0] < counts[1]
    firsts = changes.groupBy("namespace", "instrument_id", "vt").agg(F.sum(F.col("old").isNull().cast("int")).alias("n")).filter("n <> 1")
    assert firsts.count() == 0
    order = [(r["old"], r["new"]) for r in changes.filter("instrument_id = 'a'").orderBy("vt", "batch").collect()]
    assert all(b[0] is None or b[0] == a[1] for a, b in zip(order, order[1:]))  # a change begins where the one before it ended


def test_rows_without_times(spark, tmp_path):
    rows = [("bar", None, day(1), day(1), 0, 1.0, "no key"), ("bar", "a", day(1), None, 0, 1.0, "not known"), ("bar", "b", day(1), day(2), None, None, None), ("bar", "b", day(1), day(1), 0, None, "first")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/landed")
    restatement_stream(record_stream(spark, f"{tmp_path}/landed", spark.createDataFrame([], SCHEMA).schema, "parquet"), ["value", "note"], f"{tmp_path}/changes", f"{tmp_path}/progress").awaitTermination()
    assert [(r["instrument_id"], r["note"], r["revision"]) for r in standing(spark.read.parquet(f"{tmp_path}/changes")).collect()] == [("b", "first", 0)]


def test_state_over_many_batches(spark, tmp_path, monkeypatch):
    """A batch for each file, more of them than folders of state; a restarted stream goes on from it, and no key costs a call of Python."""
    from tidemark.streaming import restate

    monkeypatch.setattr(restate, "EVERY", 2)
    rows = history(5)
    schema = spark.createDataFrame([], SCHEMA).schema
    starts = [*range(0, len(rows), 15)]
    for k in starts:
        spark.createDataFrame(rows[k : k + 15], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        if k in (30, starts[-1]):
            restatement_stream(record_stream(spark, f"{tmp_path}/landed", schema, "parquet", files_per_batch=1), ["value", "note"], f"{tmp_path}/changes", f"{tmp_path}/progress").awaitTermination()
    changes = spark.read.parquet(f"{tmp_path}/changes")
    assert changes.agg(F.max("batch")).first()[0] > 2 * restate.EVERY
    assert texts(standing(changes), COLUMNS) == texts(B.as_of(spark.createDataFrame(rows, SCHEMA), day(99)), COLUMNS)
    steps = {}
    for r in changes.orderBy("batch").collect():
        assert r["old"] == steps.get(r[0:3])
        steps[r[0:3]] = r["new"]
    plan = restate.restatements(spark.createDataFrame(rows, SCHEMA), None, ["value", "note"])._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan
