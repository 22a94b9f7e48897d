"""Strategy metrics over series in ranges and Merkle trees of several tiers, against loops."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, pins


def plain_metrics(series, bps):
    returns = [0.0 if r is None else r for _, r, _ in series]
    turnover = sum(1.0 if t is None else t for _, _, t in series)
    returns[-1] -= turnover * bps / 10000
    equity = peak = 1.0
    worst = 0.0
    for r in returns:
        equity *= 1 + r
        peak = max(peak, equity)
        worst = max(worst, (peak - equity) / peak)
    spread = statistics.pstdev(returns) if len(set(returns)) > 1 else 0.0
    return len(series), sum(returns), statistics.fmean(returns) / spread * math.sqrt(len(returns)) if spread else 0.0, turnover, worst


@pytest.mark.parametrize("per_range", [10**9, 60])
def test_metrics_against_loops(spark, per_range):
    rng = random.Random(7)
    data = {"a": [(k, rng.choice([None, rng.gauss(0, 0.1)]), rng.choice([None, rng.random()])) for k in range(300)], "b": [(5, 0.25, 0.0)], "flat": [(k, 0.1, 0.0) for k in range(40)], "fall": [(k, -0.01 * k, 1.0) for k in range(50)]}
    rows = spark.createDataFrame([(s, *x) for s, xs in data.items() for x in xs], "strategy string, seq int, ret double, turnover double")
    found = {(r["strategy"], r["slippage_bps"]): tuple(r)[2:] for r in costs.metrics(rows, (0.0, 50.0), per_range=per_range).collect()}
    assert len(found) == 8
    for (s, bps), got in found.items():
        assert got == pytest.approx(plain_metrics(data[s], bps)), (s, bps)
    curve = costs.equity_curve(rows.filter("strategy = 'fall'"), ["strategy"], "seq", per_range=per_range).orderBy("seq").collect()
    equity = 1.0
    for r in curve:
        equity *= 1 - 0.01 * r["seq"]
        assert r["equity"] == pytest.approx(equity) and r["peak"] == 1.0


def test_metrics_scan_their_rows_once(spark, tmp_path):
    spark.range(500).select(F.lit("s").alias("strategy"), F.col("id").alias("seq"), F.lit(0.01).alias("ret"), F.lit(1.0).alias("turnover")).write.parquet(str(tmp_path / "rows"))
    found = costs.degrades(costs.metrics(spark.read.parquet(str(tmp_path / "rows")), (5.0, 10.0)), 5.0, 10.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(leaves):
    level = sorted(leaves)
    while len(level) > 1:
        level = [digest(level[k] + (level[k + 1] if k + 1 < len(level) else level[k])) for k in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 100])
def test_trees_of_tiers(spark, n):
    """With subtrees of four leaves a hundred leaves have four tiers; every proof gives the root, and a wrong leaf doesn't."""
    leaves = [digest(str(k % 90)) for k in range(n)]  # the last ten are there twice
    table = spark.createDataFrame([(x,) for x in leaves], "leaf string")
    want = plain_root(leaves)
    assert pins.merkle_root(table, depth=2) == pins.merkle_root(table) == want
    tiers = pins.merkle_levels(table, depth=2)
    proofs = pins.merkle_proofs(tiers, depth=2)
    found = proofs.select("i", "leaf", pins.proven_root(F.col("leaf"), F.col("proof")).alias("root"), pins.proven_root(F.lit(digest("x")), F.col("proof")).alias("other"), F.size("proof").alias("steps")).orderBy("i").collect()
    assert [r["leaf"] for r in found] == sorted(leaves) and [r["i"] for r in found] == list(range(n))
    assert all(r["root"] == want != r["other"] and r["steps"] == (n - 1).bit_length() for r in found)


def test_a_tier_has_a_row_for_each_subtree(spark):
    table = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    tiers = pins.merkle_levels(table)
    assert len(tiers) == 2 and tiers[0].count() == 3
    with pytest.raises(ValueError):
        pins.merkle_levels(table.limit(0))
