"""Trading costs, strategy metrics and how they degrade under stress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import PER_RANGE, range_ends, running

# Fixed values: (scenario, fee and slippage in basis points).
SCENARIOS = (("c-free", 0.0, 0.0), ("c-stress2x", 10.0, 20.0))


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCENARIOS), "scenario string, fee_bps double, slippage_bps double")


def net_return(gross: Column, turnover: Column, fee_bps: Column, slippage_bps: Column) -> Column:
    return gross - turnover * (fee_bps + slippage_bps) / F.lit(10000.0)


def in_all_scenarios(rows: DataFrame, gross: str = "gross", turnover: str = "turnover") -> DataFrame:
    """Each row once for every scenario, with its net return."""
    costs = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("fee_bps"), F.lit(s).alias("slippage_bps")) for n, f, s in SCENARIOS))
    wide = rows.withColumn("_c", F.explode(costs)).select(*rows.columns, "_c.scenario", "_c.fee_bps", "_c.slippage_bps")
    return wide.withColumn("net", net_return(F.col(gross), F.col(turnover), F.col("fee_bps"), F.col("slippage_bps"))).drop("fee_bps", "slippage_bps")


def only_free(free: Column, stressed: Column) -> Column:
    """Whether a strategy earns without fees and doesn't with them."""
    return (free > 0) & (stressed <= 0)


def drawdown(returns: Column) -> Column:
    """The deepest fall from a peak of an ordered array of returns; equity and peak begin at 1."""
    zero = F.struct(F.lit(1.0).alias("equity"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(a: Column, r: Column) -> Column:
        equity = a["equity"] * (1 + r)
        peak = F.greatest(a["peak"], equity)
        return F.struct(equity.alias("equity"), peak.alias("peak"), F.greatest(a["worst"], (peak - equity) / peak).alias("worst"))

    return F.aggregate(returns, zero, step, lambda a: a["worst"])


def drawdowns(rows: DataFrame, by: Sequence[str], order: str, ret: str = "ret", per_range: int = PER_RANGE) -> DataFrame:
    """(by, max_drawdown): the deepest fall from a peak of each series; equity and peak begin at 1."""
    curve = equity_curve(rows, by, order, ret, per_range)
    return curve.groupBy(*by).agg(F.greatest(F.lit(0.0), F.max("fall")).alias("max_drawdown"))


def metrics(signals: DataFrame, slippage_bps: Sequence[float], by: Sequence[str] = ("strategy",), order: str = "seq", per_range: int = PER_RANGE) -> DataFrame:
    """(by, slippage_bps, signal_count, total_return, sharpe, max_drawdown, turnover) from rows with ret and turnover.

    A missing turnover is 1, a missing return 0; costs fall on the last return.
    So all returns but the last are the same at every slippage: one scan of the
    series gives their equity, peak and deepest fall and the moments of all
    returns, and what a slippage does to the last one follows for each series.
    """
    s = signals.select(*by, order, F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("turnover", F.lit(1.0)).alias("turnover"))
    ends = range_ends(s, order, per_range)
    run = running(s, by, [order], {"_equity": ("product", 1 + F.col("ret")), "_at": ("sum", F.lit(1))}, totals=["_at"], ends=ends)
    run = running(run, by, [order], {"_peak": ("max", F.col("_equity"))}, ends=ends).withColumn("_peak", F.greatest(F.lit(1.0), "_peak"))
    left = F.col("_at_total") - F.col("_at")
    seen = run.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signal_count"), F.sum("ret").alias("_sum"), F.avg("ret").alias("_mean"), F.var_pop("ret").alias("_var"), F.sum("turnover").alias("turnover"),
        F.max(F.when(left == 0, F.col("ret"))).alias("_last"), F.max(F.when(left == 1, F.col("_equity"))).alias("_equity"), F.max(F.when(left == 1, F.col("_peak"))).alias("_peak"),
        F.min(F.when(left > 0, F.col("ret"))).alias("_low"), F.max(F.when(left > 0, F.col("ret"))).alias("_high"),
        F.max(F.when(left > 0, (F.col("_peak") - F.col("_equity")) / F.col("_peak"))).alias("_fall"),
    )
    out = seen.withColumn("slippage_bps", F.explode(F.array(*(F.lit(float(b)) for b in slippage_bps)))).withColumn("_cost", F.col("turnover") * F.col("slippage_bps") / 10000.0)
    n, last = F.col("signal_count"), F.col("_last") - F.col("_cost")
    # the moments without the last return, and with what it is after costs
    rest = F.when(n > 1, (n * F.col("_mean") - F.col("_last")) / F.nullif(n - 1, F.lit(0)))
    spread_of_rest = F.greatest(F.lit(0.0), n * F.col("_var") - (F.col("_last") - F.col("_mean")) * (F.col("_last") - rest))
    flat = (n == 1) | (F.col("_low") == F.col("_high")) & (F.col("_low") == last)
    spread = F.when(~flat, F.sqrt((spread_of_rest + (last - rest) * (last - rest) * (n - 1) / n) / n)).otherwise(0.0)
    equity = F.coalesce("_equity", F.lit(1.0)) * (1 + last)
    peak = F.greatest(F.coalesce("_peak", F.lit(1.0)), equity)
    total = F.col("_sum") - F.col("_cost")
    return out.withColumns({
        "total_return": total, "sharpe": F.when(spread > 0, total / n / F.when(spread > 0, spread) * F.sqrt(n)).otherwise(0.0),
        "max_drawdown": F.greatest(F.lit(0.0), "_fall", (peak - equity) / peak),
    }).select(*by, "slippage_bps", "signal_count", "total_return", "sharpe", "turnover", "max_drawdown")


def portfolio(found: DataFrame, by: Sequence[str] = ("slippage_bps",)) -> DataFrame:
    """Strategies' metrics together: sums, the mean Sharpe ratio and the worst drawdown."""
    return found.groupBy(*by).agg(
        F.sum("signal_count").alias("signal_count"), F.sum("total_return").alias("total_return"), F.avg("sharpe").alias("sharpe"),
        F.max("max_drawdown").alias("max_drawdown"), F.sum("turnover").alias("turnover"),
    )


def degrades(found: DataFrame, nominal: float, stressed: float, by: str = "strategy") -> DataFrame:
    """One row: whether no strategy, nor all together, gains return or loses drawdown under stress."""
    sets = found.groupingSets([[by, "slippage_bps"], ["slippage_bps"]], by, "slippage_bps")  # strategies, and all of them together
    both = sets.agg(F.grouping(by).alias("_all"), F.sum("total_return").alias("total_return"), F.max("max_drawdown").alias("max_drawdown"))
    pick = lambda c, b: F.max(F.when(F.col("slippage_bps") == b, F.col(c)))
    pairs = both.groupBy("_all", by).agg(*(pick(c, b).alias(f"{c}_{k}") for c in ("total_return", "max_drawdown") for k, b in (("a", nominal), ("b", stressed))))
    ok = (F.col("total_return_b") <= F.col("total_return_a")) & (F.col("max_drawdown_b") >= F.col("max_drawdown_a"))
    return pairs.agg(F.bool_and(ok).alias("monotone"), F.count(F.lit(1)).alias("compared"))


def equity_curve(rows: DataFrame, by: Sequence[str], order: str, ret: str = "ret", per_range: int = PER_RANGE) -> DataFrame:
    """``rows`` with running equity, its peak and the fall from it; a series of any length is many ranges."""
    ends = range_ends(rows, order, per_range)
    out = running(rows, by, [order], {"equity": ("product", 1 + F.col(ret))}, ends=ends)
    out = running(out, by, [order], {"peak": ("max", F.col("equity"))}, ends=ends).withColumn("peak", F.greatest(F.lit(1.0), "peak"))
    return out.withColumn("fall", (F.col("peak") - F.col("equity")) / F.col("peak"))
