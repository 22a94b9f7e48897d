"""Baseline strategies: signals over walk-forward folds, scored by the next day's returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import Factor, binary, evaluate, field, keep_lookback, lag, last_rows, rolling
from .bitemporal import as_of_folds
from .labels import next_day_returns, rank_ic

FOLD_KEY = ("fold_id", "instrument_id")


def sma(w: int = 3) -> Factor:
    return rolling("mean", field("close"), w)


def momentum() -> Factor:
    return binary("sub", field("close"), lag(field("close"), 1))


def fold_signal(facts: DataFrame, factor: Factor, least_rows: int = 1) -> DataFrame:
    """(fold_id, cutoff, instrument_id, vt, signal): each instrument's last value as its fold sees it.

    ``facts`` are visible rows with fold_id and cutoff; only the rows that the
    last value rests on are kept before the windows.
    """
    n = Window.partitionBy(*FOLD_KEY)
    held = facts.withColumn("_rows", F.count(F.lit(1)).over(n)).filter(F.col("_rows") >= least_rows)
    found = last_rows(evaluate(keep_lookback(held, factor.lookback, FOLD_KEY), {"signal": factor}, FOLD_KEY, status=False), FOLD_KEY)
    return found.select("fold_id", "cutoff", "instrument_id", "vt", "signal")


def buy_and_hold(facts: DataFrame) -> DataFrame:
    """The close exactly at the cutoff; an older one doesn't stand in for it."""
    return facts.filter(F.col("vt") == F.col("cutoff")).select("fold_id", "cutoff", "instrument_id", "vt", F.col("close").alias("signal"))


def fold_labels(bars: DataFrame, folds: DataFrame, calendar: DataFrame, key: Sequence[str] = ("instrument_id", "vt")) -> DataFrame:
    """(fold_id, instrument_id, fwd): return from the cutoff to the next calendar day, as known on that day."""
    ahead = folds.filter("next_day is not null").select("fold_id", F.col("next_day").alias("cutoff"), F.col("cutoff").alias("day"))
    known = as_of_folds(bars, ahead, key).join(F.broadcast(ahead.select("fold_id", "day")), "fold_id").filter("vt >= day")
    found = next_day_returns(known, calendar, ("fold_id", "instrument_id"))
    return found.join(F.broadcast(ahead.select("fold_id", F.col("day").alias("vt"))), ["fold_id", "vt"]).select("fold_id", "instrument_id", "fwd")


def score(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold_id, n_signals, mean_signal, rank_ic); 0.0 where a fold has no pair."""
    stat = signals.groupBy("fold_id").agg(F.count("signal").alias("n_signals"), F.coalesce(F.avg("signal"), F.lit(0.0)).alias("mean_signal"))
    ic = rank_ic(signals.join(labels, ["fold_id", "instrument_id"]), ["fold_id"])
    return stat.join(ic.select("fold_id", "rank_ic"), "fold_id", "left").withColumn("rank_ic", F.coalesce("rank_ic", F.lit(0.0)))


def panel_signals(bars: DataFrame, key: str = "instrument_id", order: str = "vt") -> DataFrame:
    """The five baselines on every row at once: price over its SMA3, over its expanding mean, change, cross-section rank, first price."""
    w = Window.partitionBy(key).orderBy(order)
    three, so_far = w.rowsBetween(-2, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy(order)
    out = bars.withColumns(
        {
            "b1": F.when(F.count("close").over(three) >= 3, F.try_divide(F.col("close"), F.avg("close").over(three)) - 1),
            "b2": F.when(F.count("close").over(so_far) >= 3, F.try_divide(F.col("close"), F.avg("close").over(so_far)) - 1),
            "b3": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1,
            "b5": F.first("close", ignorenulls=True).over(so_far),
        }
    )
    rank = F.rank().over(day.orderBy("close")) + (F.count(F.lit(1)).over(Window.partitionBy(order, "close")) - 1) / F.lit(2.0)
    return out.withColumn("b4", rank / F.count("close").over(day))
