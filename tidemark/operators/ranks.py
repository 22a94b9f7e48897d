"""Places, medians and running sums over very many rows, without one task that holds them all.

Rows are dealt to ranges of their first order column.  The ranges' ends are
quantiles of the data, so they hold about as many rows each however the values
are spread; a count for each range, and places within it, give places over all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are dealt to.
RANGES = 128


def ends_of(rows: DataFrame, value: str, ranges: int = RANGES) -> list:
    """At most ``ranges`` - 1 distinct values that part the rows about evenly."""
    shares = [k / ranges for k in range(1, ranges)]
    kind = dict(rows.dtypes)[value]
    number = F.col(value) if kind not in ("date", "timestamp", "string") else F.xxhash64(value) if kind == "string" else F.unix_date(F.to_date(value))
    found = rows.agg(F.percentile_approx(number, shares, 10_000)).first()[0]
    return sorted(set(found or ()))


def range_of(value: Column, kind: str, ends: Sequence) -> Column:
    """The number of the range that a value is in: how many ends are below it; nulls are before all."""
    number = F.unix_date(F.to_date(value)) if kind in ("date", "timestamp") else value
    if not ends:
        return F.lit(0)
    below = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < number))
    return F.when(value.isNull(), F.lit(0)).otherwise(below)


def placed(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), place: str = "place", total: str | None = None) -> DataFrame:
    """``rows`` with their place from 1 in ``order`` (nulls first) among those that agree in ``by``, and the number of those.

    The first column of ``order`` is a number or a day and parts the rows into
    ranges; rows that agree in it are in one range.
    """
    kind = dict(rows.dtypes)[order[0]]
    ranged = rows.withColumn("_range", range_of(F.col(order[0]), kind, ends_of(rows, order[0])))
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_in"))
    of_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each group and range
    before = sizes.withColumns({"_before": F.sum("_in").over(of_group.orderBy("_range")) - F.col("_in"), "_total": F.sum("_in").over(of_group)}).drop("_in")
    same = F.lit(True)
    for c in [*by, "_range"]:
        same &= ranged[c].eqNullSafe(before[c])
    inner = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    held = ranged.withColumn("_inner", inner).join(before.hint("merge" if by else "broadcast"), same).select(ranged["*"], "_inner", "_before", "_total")
    out = held.withColumn(place, F.col("_before") + F.col("_inner"))
    out = out.withColumn(total, F.col("_total")) if total else out
    return out.drop("_range", "_inner", "_before", "_total")


def medians(rows: DataFrame, by: Sequence[str], values: dict[str, str]) -> DataFrame:
    """(by, median of each value): exact, by counting.

    Distinct values are counted, their running counts are taken by ranges, and
    the one or two in the middle are averaged; no task holds a group.
    """
    out = None
    for name, value in values.items():
        counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_range", range_of(F.col("_v"), dict(counts.dtypes)["_v"], ends_of(rows, value)))
        sizes = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
        before = sizes.withColumns({"_before": F.sum("_in").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_in"), "_total": F.sum("_in").over(Window.partitionBy(*by))}).drop("_in")
        inner = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_v"))
        ranked = counts.withColumn("_to", inner).join(before.hint("merge"), [*by, "_range"]).withColumn("_to", F.col("_to") + F.col("_before"))
        low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
        holds = lambda at: (F.col("_to") >= at) & (F.col("_to") - F.col("_n") < at)
        middle = ranked.groupBy(*by).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(name))
        out = middle if out is None else out.join(middle, list(by), "full")
    return out
