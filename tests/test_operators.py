"""Operators against plain versions of the same rules, on rows where simpler rules give other answers."""

import datetime as dt
import os
import random
import statistics

import pytest

from tidemark.functions import factors as X
from tidemark.operators import bitemporal, costs, pins, ranks, runlog
from tidemark.operators import projections as P
from tidemark.sources import ingest
from tidemark.streaming.append import append_stream, record_stream


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_restatements_replace_what_they_restate(spark):
    facts = [("a", day(0), day(2), 0, 100.75), ("a", day(0), day(5), 1, 90.25), ("a", day(-9), day(8), 0, 1.5), ("b", day(0), day(0), 0, None), ("b", None, day(0), 0, 7.0)]
    right = spark.createDataFrame(facts, "i string, vt date, kt date, revision int, revenue double")
    left = spark.createDataFrame([("a", day(n)) for n in (1, 2, 4, 5, 9)] + [("b", day(1)), ("c", day(1))], "i string, vt date")
    found = {(r["i"], r["vt"]): (r["revenue_vt"], r["revenue"]) for r in bitemporal.known_join(left, right, "i", "revenue").collect()}
    assert found == {
        ("a", day(1)): (None, None), ("a", day(2)): (day(0), 100.75), ("a", day(4)): (day(0), 100.75), ("a", day(5)): (day(0), 90.25), ("a", day(9)): (day(0), 90.25),
        ("b", day(1)): (day(0), None), ("c", day(1)): (None, None),
    }


def test_an_attempt_has_one_receipt(spark):
    log = [
        (1, 0, "running", 1), (1, 0, "failed", 2), (1, 0, "completed", 3), (1, 0, "completed", 4),
        (1, 1, "queued", 5), (1, 1, "completed", 6), (1, 1, "running", 7), (1, 1, "completed", 8), (1, 2, "running", 9), (1, 2, "completed", 10),
    ]
    rows = spark.createDataFrame(log, "work_order int, retry_seq int, state string, seq int")
    found = {r["seq"]: r["outcome"] for r in runlog.receipt_outcomes(rows).collect()}
    assert found == {2: "ended", 3: "invalid", 4: "invalid", 6: "invalid", 8: "committed", 10: "superseded_duplicate"}


def test_a_success_with_an_error_ends_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "ok", "e"), (1, 2, "ok", None), (1, 3, "ok", None), (1, 4, "bad", "e")], "run int, seq int, state string, error string")
    found = runlog.finalize_conflicts(rows, "run", "seq", ["state"], rows["state"].eqNullSafe("ok") & rows["error"].isNotNull())
    assert {r["seq"]: r["verdict"] for r in found.collect()} == {1: "refused", 2: "first", 3: "repeated", 4: "conflict"}


def test_no_value_no_place(spark):
    rows = spark.createDataFrame([("a", day(0), 3.0), ("b", day(0), None), ("c", day(0), 1.0), ("d", day(0), float("nan"))], "instrument_id string, vt date, close double")
    for op, want in (("rank", {"c": 0.5, "a": 1.0}), ("zscore", {"c": -1.0, "a": 1.0})):
        assert {r["instrument_id"]: r["cs"] for r in X.evaluate_cross_section(rows, op, X.field("close")).collect()} == want


def test_vendor_dates(spark):
    texts = {"0": day(0).replace(1970), "86400000": dt.date(1970, 1, 2), "1704153600000": day(1), "2024-01-02": day(1), "2024-01-02T23:59:59Z": day(1), "9" * 18: None, "9" * 30: None, "x": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["d"] for r in rows.select("t", ingest.vendor_date(rows["t"]).alias("d")).collect()} == texts


def test_keys_that_a_run_lacks(spark):
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 2, "x"), ("d", 1, "x"), ("d", 1, "x"), ("d", 2, "x")], "k string, run int, h string")
    assert {(r["k"], r["n_digests"], r["n_seen"]) for r in pins.unstable_keys(runs, ["k"], "h").collect()} == {("b", 2, 2), ("c", 1, 1)}


def test_missing_takes_nulls_as_equal(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, None], [2, None]))
    assert [r["k"] for r in runlog.missing(a, b, ["k"]).collect()] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_drawdowns(spark, seed):
    r = random.Random(seed)
    rows = [(s, k, r.gauss(0, 0.3) if seed else r.gauss(0, 0.9)) for s in "ab" for k in range(900)] + [("c", 1, 0.5)]
    plain = {}
    for s in "abc":
        equity, peak, worst = 1.0, 1.0, 0.0
        for _, _, x in sorted(y for y in rows if y[0] == s):
            equity *= 1 + x
            peak = max(peak, equity)
            worst = max(worst, (peak - equity) / peak)
        plain[s] = worst
    table = spark.createDataFrame(rows, "s string, seq int, ret double")
    assert {x["s"]: x["max_drawdown"] for x in costs.drawdowns(table, ["s"], "seq").collect()} == pytest.approx(plain)


@pytest.mark.parametrize("values", [[], [5.0], [None, None], [0.0] * 50 + [1.0], None])
def test_places_and_medians(spark, values):
    r = random.Random(4)
    values = [r.expovariate(1) ** 4 if r.random() > 0.1 else None for _ in range(2000)] if values is None else values
    rows = [(k % 3, k, v) for k, v in enumerate(values)]
    table = spark.createDataFrame(rows, "g int, k int, v double")
    order = lambda x: (x[2] is not None, x[2] or 0.0, x[1])
    plain = {x[1]: n for g in range(3) for n, x in enumerate(sorted((x for x in rows if x[0] == g), key=order), 1)}
    assert {x["k"]: x["place"] for x in ranks.placed(table, ["v", "k"], ["g"]).collect()} == plain
    assert {x["k"]: x["place"] for x in ranks.placed(table, ["v", "k"]).collect()} == {x[1]: n for n, x in enumerate(sorted(rows, key=order), 1)}
    held = {g: [x[2] for x in rows if x[0] == g and x[2] is not None] for g in range(3)}
    assert {x["g"]: x["m"] for x in ranks.medians(table, ["g"], {"m": "v"}).collect()} == pytest.approx({g: statistics.median(v) for g, v in held.items() if v})


def test_a_batch_that_is_repeated_is_written_once(spark, tmp_path):
    rows = [("bar", k, day(0), day(0), 0, dt.datetime(2024, 1, 1)) for k in range(20)] + [("bar", 3, day(0), day(0), 0, dt.datetime(2024, 1, 1)), ("?", 99, day(0), day(0), 0, dt.datetime(2024, 1, 1))]
    table = spark.createDataFrame(rows, "namespace string, instrument_id int, vt date, kt date, revision int, arrived timestamp")
    table.write.parquet(str(tmp_path / "landed"))

    def run():
        append_stream(record_stream(spark, str(tmp_path / "landed"), table.schema, "parquet"), *(str(tmp_path / x) for x in ("facts", "rejected", "progress"))).awaitTermination()
        return spark.read.parquet(str(tmp_path / "facts")).count(), spark.read.json(str(tmp_path / "rejected")).count()

    assert run() == (20, 1)
    for file in os.listdir(tmp_path / "progress" / "commits"):
        if file.lstrip(".").split(".")[0] == "0":  # as if the job had ended before it noted that batch 0 was done
            os.remove(tmp_path / "progress" / "commits" / file)
    for file in os.listdir(tmp_path / "progress" / "commits"):
        os.remove(tmp_path / "progress" / "commits" / file)
    assert run() == (20, 1)


def test_receipts_without_clocks(spark):
    one = '{"work_order_hash": "w", "terminal_status": "completed", "metrics": [{"name": "b", "value": 2.0}, {"name": "a", "value": 1.0}], "artifact_manifest": [{"path": "/x", "sha256": "f"}, {"path": "/y", "sha256": "e"}], "finished_at": 5}'
    two = one.replace('"finished_at": 5', '"finished_at": 9, "worker_id": "z"').replace("/x", "/other")
    found = P.receipt_projection(spark.createDataFrame([(1, one), (2, two), (3, '{"work_order_hash": "v"}')], "k int, receipt string")).collect()
    assert found[0][1:] == found[1][1:] and found[0]["artifact_sha256"] == ["e", "f"] and [m["name"] for m in found[0]["metrics"]] == ["a", "b"]
    assert found[2]["artifact_sha256"] == [] and found[2]["terminal_status"] is None


def test_manifest_of_files(spark, tmp_path):
    import hashlib

    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(name.encode() * 100)
    sha = hashlib.sha256(b"a.bin" * 100).hexdigest()
    manifest = spark.createDataFrame([("a.bin", sha), ("b.bin", sha), ("c.bin", sha)], "file string, expected string")
    assert {r["file"]: r["matches"] for r in ingest.verify_files(spark, [str(tmp_path / "a.bin"), str(tmp_path / "b.bin")], manifest).collect()} == {"a.bin": True, "b.bin": False, "c.bin": False}


def test_grid_order(spark):
    rows = [("x", None, "t2"), ("x", None, "t1"), (None, "b", "t1"), ("x", "a", "t0")]
    grid = spark.createDataFrame(rows, "d1 string, d2 string, task_type string")
    found = [tuple(r)[:3] for r in P.canonical_order(grid, ["d1", "d2"]).orderBy("place").collect()]
    assert found == [(None, "b", "t1"), ("x", None, "t1"), ("x", None, "t2"), ("x", "a", "t0")]


def test_jdbc(spark):
    """Written and read back over JDBC in ranges of a column, with a filter that goes to the server (Derby, in this JVM)."""
    import uuid

    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([("bar", k, float(k) / 4) for k in range(100)], "namespace string, instrument_id int, value double")
    ingest.write_jdbc(rows.filter("instrument_id < 60"), url, "records", **driver)
    ingest.write_jdbc(rows.filter("instrument_id >= 60"), url, "records", **driver)
    found = ingest.read_jdbc(spark, url, "records", "instrument_id", 0, 100, 4, **driver)
    assert found.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    some = found.filter("instrument_id = 7")
    assert "PushedFilters: [*IsNotNull(instrument_id), *EqualTo(instrument_id,7)]" in some._jdf.queryExecution().toString() and some.count() == 1
