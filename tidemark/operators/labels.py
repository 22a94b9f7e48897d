"""Next-day returns and rank correlations of signals with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_day_returns(bars: DataFrame, calendar: DataFrame, key: Sequence[str] = ("instrument_id",), name: str = "fwd") -> DataFrame:
    """(key, vt, fwd): close on the next calendar day over close, less 1.

    The next day is the calendar's, not the instrument's next row; there is no
    label without a bar on it or where the close is 0.
    """
    days = F.broadcast(calendar.select(F.col("day").alias("vt"), F.col("next_day")))
    later = bars.select(*key, F.col("vt").alias("next_day"), F.col("close").alias("_next"))
    met = bars.select(*key, "vt", "close").join(days, "vt").join(later, [*key, "next_day"])
    return met.filter("close <> 0").select(*key, "vt", (F.col("_next") / F.col("close") - 1).alias(name))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of population moments; 0 where either doesn't vary."""
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.sqrt(spread)).otherwise(F.lit(0.0))


def ordinal_rank(by: Sequence[str], value: str, tie: str = "instrument_id") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)).cast("double")


def average_rank(by: Sequence[str], value: str) -> Column:
    """Ranks from 1; equal values share their mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / F.lit(2.0)


def rank_ic(rows: DataFrame, by: Sequence[str], signal: str = "signal", ret: str = "fwd", tie: str = "instrument_id") -> DataFrame:
    """(by, n, rank_ic): correlation of ordinal ranks, ties in the order of ``tie``.

    0.0 for fewer than two rows or a constant signal; constant returns are
    still ranked, by the ties.
    """
    rows = rows.filter(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    ranked = rows.withColumns({"_a": ordinal_rank(by, signal, tie), "_b": ordinal_rank(by, ret, tie)})
    flat = F.min(signal) == F.max(signal)
    ic = F.when((F.count(F.lit(1)) < 2) | flat, 0.0).otherwise(correlation(F.col("_a"), F.col("_b")))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ic.alias("rank_ic"))


def mean_ic(by_day: DataFrame) -> DataFrame:
    """One row (mean_ic, days): the mean of the days that have a correlation, 0.0 if none has."""
    return by_day.agg(F.coalesce(F.avg("rank_ic"), F.lit(0.0)).alias("mean_ic"), F.count("rank_ic").alias("days"))


def spearman_by_day(rows: DataFrame, by: Sequence[str], signal: str = "signal", ret: str = "fwd") -> DataFrame:
    """(by, n, rank_ic) with average ranks; days of fewer than two rows or without variation have none."""
    rows = rows.filter(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    ranked = rows.withColumns({"_a": average_rank(by, signal), "_b": average_rank(by, ret)})
    varies = (F.count(F.lit(1)) >= 2) & (F.var_pop("_a") > 0) & (F.var_pop("_b") > 0)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(varies, correlation(F.col("_a"), F.col("_b"))).alias("rank_ic"))
