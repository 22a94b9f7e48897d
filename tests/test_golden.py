"""The canonical panel's known values, and rules that hold whatever the data."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import catalog
from tidemark.functions import factors as X
from tidemark.operators import baselines as E
from tidemark.operators import bitemporal as B
from tidemark.operators import costs, labels, pins, rules, search
from tidemark.sources import fixture


@pytest.fixture(scope="module")
def panel(spark):
    return fixture.panel(spark).persist()


@pytest.fixture(scope="module")
def world(spark, panel):
    days = fixture.weekdays(spark)
    calendar = days.alias("a").join(days.alias("b"), F.col("b.di") == F.col("a.di") + 1, "left").select(F.col("a.vt").alias("day"), F.col("b.vt").alias("next_day"), F.col("a.di").alias("idx"))
    bars = panel.filter("namespace = 'bar'")
    return bars, calendar


def folds_at(calendar, *idx):
    return calendar.filter(F.col("idx").isin(*idx)).select(F.col("idx").alias("fold_id"), F.col("day").alias("cutoff"), "next_day")


def test_panel_size(panel):
    assert panel.count() == 383
    assert B.duplicate_keys(panel).count() == 0


def ics(signals, bars, folds, calendar):
    found = E.score(signals, E.fold_labels(bars, folds, calendar, ("instrument_id", "vt")))
    return [round(r["rank_ic"], 6) for r in found.orderBy("fold_id").collect()]


def test_rank_ics(world):
    bars, calendar = world
    folds = folds_at(calendar, 19, 39, 58)
    facts = B.as_of_folds(bars, folds, ("instrument_id", "vt"))
    assert ics(E.fold_signal(facts, E.sma(3), 3), bars, folds, calendar) == [-0.142857, 0.428571, 0.314286]
    last = folds_at(calendar, 58)
    facts = B.as_of_folds(bars, last, ("instrument_id", "vt"))
    assert ics(E.fold_signal(facts, E.momentum(), 2), bars, last, calendar) == [-0.714286]
    assert ics(E.buy_and_hold(facts), bars, last, calendar) == [0.314286]
    ranks = X.evaluate_cross_section(facts, "rank", X.field("close"), group=["fold_id"]).withColumnRenamed("cs", "signal")
    assert ics(ranks, bars, last, calendar) == [0.314286]


def test_as_of_never_shows_the_future(panel):
    k = F.lit("2024-01-20").cast("date")
    seen = B.as_of(panel, k)
    assert seen.filter(F.col("kt") > k).count() == 0
    assert B.as_of(panel, k, instruments=[]).count() == 0
    assert B.as_of(panel, k, vt_start=F.lit("2024-02-01").cast("date"), vt_end=F.lit("2024-01-01").cast("date")).count() == 0


def test_higher_revision_known_earlier_wins(spark):
    rows = spark.sql("select 'bar' namespace, 'A' instrument_id, date'2024-01-01' vt, date(kt) kt, revision, value from values ('2024-01-05', 0, 1.0), ('2024-01-02', 1, 2.0) t(kt, revision, value)")
    assert B.as_of(rows, F.lit("2024-01-09").cast("date")).first()["value"] == 2.0


def test_order_of_arrival_changes_nothing(panel):
    a = pins.snapshot_pin(panel).first()
    assert a == pins.snapshot_pin(panel.orderBy(F.rand(3))).first()
    assert a["n"] == 383
    assert a["pin"] != pins.snapshot_pin(panel.limit(382)).first()["pin"]


def plain_root(leaves):
    level = sorted(leaves)
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2])]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_merkle_root(spark, n):
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    assert pins.merkle_root(spark.createDataFrame([(x,) for x in leaves], "leaf string")) == plain_root(leaves)


def test_merkle_root_of_holdout(spark):
    """A hundred generated records of five symbols over twenty days, whose root is known."""
    leaves = fixture.holdout(spark).select(F.sha2("line", 256).alias("leaf"))
    assert leaves.count() == 100
    assert pins.merkle_root(leaves) == "cc7d65a7e660456872d029e6851c9f88cdfd450e51db80b5af139dd27f59c2c4"


def plain_window(values, w, stat):
    return [None if k + 1 < w else stat(values[k + 1 - w : k + 1]) for k in range(len(values))]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([1.0, 2.0, 2.0, 3.5, 7.0]), min_size=1, max_size=14), st.integers(1, 5))
def test_rolling_statistics(spark, values, w):
    rows = spark.createDataFrame([("A", k, v) for k, v in enumerate(values)], "instrument_id string, vt int, close double")
    c = X.field("close")
    ops = {"rank": lambda x: sum(y <= x[-1] for y in x) / w, "idxmax": lambda x: float(x.index(max(x))), "idxmin": lambda x: float(x.index(min(x))), "sum": sum, "max": max}
    found = X.evaluate(rows, {op: X.rolling(op, c, w) for op in ops}, status=False).orderBy("vt").collect()
    for op, stat in ops.items():
        assert [r[op] for r in found] == pytest.approx(plain_window(values, w, stat))


def test_truncating_the_future_changes_nothing(world):
    bars, calendar = world
    cut = calendar.filter("idx = 30").first()["day"]
    factor = {"v": X.rolling("slope", X.field("close"), 5)}
    whole = X.evaluate(bars, factor, status=False).filter(F.col("vt") <= F.lit(cut)).select("instrument_id", "vt", "v")
    part = X.evaluate(bars.filter(F.col("vt") <= F.lit(cut)), factor, status=False).select("instrument_id", "vt", "v")
    assert pins.parity(whole, part).first() == (0, 0)


def test_refusals():
    c = X.field("close")
    for bad in (lambda: X.lag(c, -1), lambda: X.rolling("mean", c, 0), lambda: X.rolling("mean", c, 3, 0.5), lambda: X.rolling("quantile", c, 3, 2), lambda: X.rolling_pair("corr", c, c, 1),
                lambda: X.fundamental("revenue", 10), lambda: X.lag(X.cross_section("rank", c, "U"), 1), lambda: X.unary("exp", c)):
        with pytest.raises(ValueError):
            bad()
    assert X.lag(X.rolling("mean", c, 5), 2).lookback == 6
    assert len(catalog.features()) == 158


def test_division_by_literal_zero_is_refused(world):
    with pytest.raises(ValueError):
        X.evaluate(world[0], {"v": X.binary("div", X.field("close"), X.const(0))})


def test_zero_close_and_gap_have_no_label(spark):
    cal = spark.sql("select date(d) day, date(n) next_day from values ('2024-01-01','2024-01-02'),('2024-01-02','2024-01-03'),('2024-01-03',null) t(d, n)")
    bars = spark.sql("select i instrument_id, date(d) vt, c close from values ('A','2024-01-01',0.0D),('A','2024-01-02',2.0D),('B','2024-01-01',1.0D),('B','2024-01-03',3.0D) t(i, d, c)")
    assert labels.next_day_returns(bars, cal).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0001, 0.001, 0.01, 0.02, 0.03, 0.2, 0.9]), min_size=1, max_size=30))
def test_benjamini_hochberg(spark, p):
    found = search.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double")).collect()
    order = sorted(p)
    cut = max((x for k, x in enumerate(order, 1) if x <= 0.05 * k / len(p)), default=-1)
    assert sorted((r["p"], r["accepted"]) for r in found) == sorted((x, x <= cut) for x in p)


def test_spearman_p(spark):
    rows = spark.createDataFrame([(0.5, 10), (0.9, 5), (1.0, 8), (0.3, 2), (0.0, 20)], "r double, n int")
    found = [r[0] for r in rows.select(search.spearman_p(F.col("r"), F.col("n"))).collect()]
    assert found == pytest.approx([0.141111, 0.037386, 0.0, 1.0, 1.0], abs=1e-5)


def test_drawdown_and_rules(spark):
    row = spark.range(1).select(costs.drawdown(F.array(F.lit(0.1), F.lit(-0.2), F.lit(0.05))).alias("d"), rules.veto(F.lit(0.6), F.lit("buy"), F.lit(0.5), F.lit(0.0), F.lit(0.2)).alias("v"), rules.fill_fault(F.lit(2), F.lit(2)).alias("f"), rules.asks_override(F.lit("Please IGNORE RISK now")).alias("o")).first()
    assert row["d"] == pytest.approx(0.2) and row["v"] == "gross_exposure" and row["f"] == "same_bar" and row["o"]


def test_pages(spark, tmp_path):
    from tidemark.sources import ingest

    (tmp_path / "a.json").write_text('{"results": [{"t": 1704153600000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 100, "vw": 1.2, "n": 7}]}')
    (tmp_path / "b.json").write_text('{"results": null}')
    (tmp_path / "c.json").write_text("not json")
    good, bad = ingest.read_pages(spark, str(tmp_path), ingest.BAR_PAGE)
    assert [r["close"] for r in ingest.bar_records(good, F.lit("AAA"), "run").collect()] == [1.5]
    assert bad.count() == 2


def test_split_before_it_is_announced(panel, spark):
    points = spark.sql("select 'CCC' instrument_id, date(v) vt, date(k) kt from values ('2024-02-20','2024-02-20'),('2024-02-10','2024-02-20'),('2024-02-20','2024-01-20') t(v, k)")
    found = B.split_ratio(points, panel.filter("namespace = 'corporate_action'").select("instrument_id", "vt", "kt", "ratio")).orderBy("kt", "vt").collect()
    assert [r["split_ratio"] for r in found] == [1.0, 1.0, 2.0]


def test_depth(panel):
    row = B.depth(panel).first()
    assert row["ok"] and row["message"] == "ok 6/60/4"
    assert not B.depth(panel.filter("namespace <> 'universe'")).first()["ok"]


def test_close_matrix(spark):
    rows = {(r["instrument_id"], str(r["vt"])): r["close"] for r in fixture.close_matrix(spark).collect()}
    assert len(rows) == 180 and rows["AAA", "2024-01-02"] == pytest.approx(80.33) and rows["DDD", "2024-01-03"] == pytest.approx(101.455)


@pytest.mark.parametrize("name", ["l2_candidate_rank_ic", "l3_factor_grid"])
def test_whole_grid_is_scored(spark, data, monkeypatch, name):
    from tidemark.operators import search
    from tidemark.plans import registry

    seen = {}

    class Seen(Exception):
        pass

    def values(bars, factors, *more):
        seen.update(factors)
        raise Seen

    monkeypatch.setattr(search, "candidate_values", values)
    with pytest.raises(Seen):
        registry.queries()[name](spark, data)
    fields = ("close", "volume", "open", "high", "low")
    assert set(seen) == {f"{op}_{f}_{w}" for f in fields for op in ("mean", "std", "sum") for w in range(2, 11)} | {f"{op}_{f}_lag{k}" for f in fields for op in ("add", "sub", "mul") for k in range(1, 6)}
    assert len(seen) == 210
