"""Rolling statistics that are put together of shorter windows, against plain Python over each window."""

import math
import random
import re
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from tidemark.functions import catalog
from tidemark.functions import factors as X
from tidemark.plans import views

LENGTHS = (1, 2, 5, 7, 8, 9, 13, 20, 30, 60, 61, 64, 125)


@pytest.fixture(scope="module")
def rows():
    """Three histories: many ties, values that are missing, and one that never varies; the last is shorter than most windows."""
    r = random.Random(5)
    out = [("a", t, float(r.randrange(6)), r.uniform(-1, 1)) for t in range(150)]
    out += [("b", t, None if t == 70 else r.uniform(-50, 50), r.uniform(-1, 1)) for t in range(150)]
    out += [("c", t, 1.1, 3.3) for t in range(12)]
    return out


def windows(rows, w, column=2):
    """{(instrument, t): values of its last w rows} where all of them have one."""
    held, out = {}, {}
    for row in sorted(rows, key=lambda row: row[:2]):
        values = held.setdefault(row[0], [])
        values.append(row[column])
        if len(values) >= w and None not in values[-w:]:
            out[row[:2]] = values[-w:]
    return out


def moment(x, y):
    mx, my = fmean(x), fmean(y)
    return fmean([(a - mx) * (b - my) for a, b in zip(x, y)])


PLAIN = {
    "mean": fmean,
    "sum": math.fsum,
    "std": lambda x: math.sqrt(moment(x, x)),
    "max": max,
    "min": min,
    "rank": lambda x: sum(y <= x[-1] for y in x) / len(x),
    "idxmax": lambda x: float(x.index(max(x))),
    "idxmin": lambda x: float(x.index(min(x))),
    "quantile": lambda x: sorted(x)[int(0.8 * (len(x) - 1))],
    "slope": lambda x: moment(x, range(len(x))) / moment(range(len(x)), range(len(x))) if len(x) > 1 else 0.0,
}


def test_all_lengths_in_one_plan(spark, rows):
    frame = spark.createDataFrame(rows, "instrument_id string, vt int, x double, y double")
    wanted = {f"{op}{w}": X.rolling(op, X.field("x"), w, 0.8 if op == "quantile" else None) for op in PLAIN for w in LENGTHS}
    found = {(r["instrument_id"], r["vt"]): r for r in X.evaluate(frame, wanted, status=False).collect()}
    for w in LENGTHS:
        plain = windows(rows, w)
        for at, row in found.items():
            for op, of in PLAIN.items():
                if at in plain:
                    assert row[f"{op}{w}"] == pytest.approx(of(plain[at]), rel=1e-9, abs=1e-9), (op, w, at)
                else:
                    assert row[f"{op}{w}"] is None, (op, w, at)


def test_pairs_of_all_lengths(spark, rows):
    frame = spark.createDataFrame(rows, "instrument_id string, vt int, x double, y double")
    lengths = [w for w in LENGTHS if w > 1]
    wanted = {f"{op}{w}": X.rolling_pair(op, X.field("x"), X.field("y"), w) for op in ("cov", "corr") for w in lengths}
    found = {(r["instrument_id"], r["vt"]): r for r in X.evaluate(frame, wanted, status=False).collect()}
    for w in lengths:
        x, y = windows(rows, w), windows(rows, w, 3)
        for at, row in found.items():
            if at not in x:
                assert row[f"cov{w}"] is None and row[f"corr{w}"] is None
                continue
            cov, spread = moment(x[at], y[at]), math.sqrt(moment(x[at], x[at]) * moment(y[at], y[at]))
            assert row[f"cov{w}"] == pytest.approx(cov, rel=1e-9, abs=1e-9)
            if at[0] == "c":
                assert row[f"cov{w}"] == 0 and row[f"corr{w}"] == 0  # a window that doesn't vary has variance exactly 0
            else:
                assert row[f"corr{w}"] == pytest.approx(cov / spread if spread else 0.0, rel=1e-9, abs=1e-9)


def test_nan_is_the_largest_value(spark):
    nan = float("nan")
    frame = spark.createDataFrame([("a", t, v) for t, v in enumerate([2.0, nan, 1.0, nan, 3.0, 1.0, 0.0, -0.0, 5.0, 1.0])], "instrument_id string, vt int, x double")
    ops = ("rank", "idxmax", "idxmin")
    got = X.evaluate(frame, {op: X.rolling(op, X.field("x"), 10) for op in ops} | {"r4": X.rolling("rank", X.field("x"), 4)}, status=False).orderBy("vt").collect()
    assert [got[9][op] for op in ops] == [0.5, 1.0, 6.0]
    assert got[3]["r4"] == 1.0 and got[7]["r4"] == 0.5


def test_no_lists_and_two_passes(spark):
    """Sorted runs hold no list a row, and more windows over a column add no pass over the rows."""
    frame = spark.range(300).select(F.lit("a").alias("instrument_id"), F.col("id").alias("vt"), F.rand(1).alias("x"))

    def plan(lengths):
        wanted = {f"{op}{w}": X.rolling(op, X.field("x"), w) for op in ("rank", "quantile", "idxmax", "mean", "std") for w in lengths}
        return X.evaluate(frame, wanted, status=False)._jdf.queryExecution().optimizedPlan().toString()

    few, many = plan((10, 60)), plan((10, 15, 20, 30, 45, 60))
    assert "collect_list" not in many
    assert few.count("Window [") == many.count("Window [") <= 4


#: Bytes of a method beyond which the JVM doesn't compile it but interprets it for every row.
COMPILED = 8000


@pytest.mark.parametrize("name", ["CORR", "CORD", "RSQR", "STD", "RESI", "WVMA"])
def test_generated_code_is_compiled(spark, data, capsys, name):
    """A family's windows in one plan stay below what the JVM compiles."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the code is there before the plan has run
    try:
        catalog.compute(views.long_bars(spark, data), [name]).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < COMPILED


def test_presence_is_where_values_are(spark):
    """What a value needs, told without computing it, against the values: missing fields, zeros, NaN and logarithms that can't be had."""
    r, odd = random.Random(3), {"open": (None, 0.0, -0.0), "high": (None, 1e-12), "low": (None, 2e-12), "close": (None, 0.0, float("nan"), -3.0), "volume": (None, 0.0, -1e-12, -1.0, -7.0, 3.0), "vwap": (None,)}
    rows = [(k, t, *(r.choice(some) if r.random() < rare else r.uniform(1, 9) for some in odd.values())) for k, rare in (("a", 0.0), ("b", 0.02), ("c", 0.2), ("d", 0.7)) for t in range(90)]
    rows += [("e", t, 0.0, 0.0, 1e-12, 1.0, -1e-12, 1.0) for t in range(12)]  # divisors that are 0 with their guard
    frame = spark.createDataFrame(rows, "instrument_id string, vt int, open double, high double, low double, close double, volume double, vwap double")
    x, y = X.field("close"), X.field("volume")
    wanted = catalog.features(windows=(5, 20)) | {
        "power": X.binary("signed_power", x, y), "deep": X.rolling("mean", X.lag(X.unary("log", X.binary("div", x, y)), 2), 3), "absent": X.field("nothing"),
        "zero": X.binary("div", x, X.unary("neg", X.unary("abs", X.const(0)))), "folded": X.binary("div", x, X.rolling("sum", X.unary("abs", y), 12)),
        "cov": X.rolling_pair("cov", X.binary("div", y, X.rolling("idxmax", x, 4)), x, 3), "fixed": X.const(2),
    }
    values = {(v["instrument_id"], v["vt"]): v for v in X.evaluate(frame, wanted, status=False).collect()}
    found, names = X.presence(frame, wanted)
    assert set(names) == set(wanted) and len(set(names.values())) < len(wanted)
    told = found.collect()
    assert len(told) == len(rows)
    for row in told:
        for name, need in names.items():
            assert row[need] == (values[row["instrument_id"], row["vt"]][name] is not None), (name, row["instrument_id"], row["vt"])
    counted = {row["family"]: row["values"] for row in catalog.coverage(frame, windows=(5, 20)).collect()}
    assert counted["total"] == sum(v[n] is not None for v in values.values() for n in catalog.features(windows=(5, 20)))


def test_coverage_computes_no_more_than_counts_need(spark, data, capsys):
    """Runs and moments that decide on no value aren't computed, bars and windows share an exchange, and what is left is compiled."""
    found = catalog.coverage(views.long_bars(spark, data))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 5 and not re.search("sort_array|var_pop|covar_pop", plan)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = catalog.coverage(views.long_bars(spark, data))
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(l_suppkey") == 1
        found.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < COMPILED
