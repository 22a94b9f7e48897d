"""Running values over very long series, without one task that holds a series.

A prefix scan has two passes: rows are dealt to ranges of their order whose ends
are quantiles, a range runs from nothing, and what the ranges before have left (a
row for each series and range) is put on top.  Up to ``PER_RANGE`` rows there
is one range and one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range about, and ranges at most.
PER_RANGE, MOST_RANGES = 2_000_000, 4096
#: Ends of ranges that are compared one after the other before a finer list is taken.
STRIDE = 64


def as_number(value: Column, kind: str) -> Column:
    """A number, day or time as a number that has its order."""
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(value).cast("double") if kind == "timestamp" else F.unix_micros(value.cast("timestamp")).cast("double")
    if kind == "string":
        raise ValueError("ranges are of numbers, days or times")
    return value.cast("double")


def range_ends(rows: DataFrame, column: str, per_range: int = PER_RANGE) -> list[float]:
    """Distinct values that part the rows evenly, as many as the number of rows asks for; none for few rows."""
    number = as_number(F.col(column), dict(rows.dtypes)[column])
    n = rows.count()
    ranges = min(MOST_RANGES, -(-n // per_range))
    if ranges < 2:
        return []
    found = rows.agg(F.percentile_approx(number, [k / ranges for k in range(1, ranges)], 100_000)).first()[0]
    return sorted({x for x in found or () if x == x})


def range_number(value: Column, ends: Sequence[float]) -> Column:
    """How many ends are below a number; nulls come first.  A coarse list of ends says which fine one to look at."""
    if not ends:
        return F.lit(0)
    fine = [list(ends[k : k + STRIDE]) for k in range(0, len(ends), STRIDE)]
    below = lambda array: F.size(F.filter(array, lambda end: end < value))
    coarse = below(F.array(*(F.lit(part[-1]) for part in fine)))
    own = F.element_at(F.array(*(F.array(*map(F.lit, part)) for part in fine)), F.least(coarse + 1, F.lit(len(fine))))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.when(coarse == len(fine), F.lit(len(ends))).otherwise(coarse * STRIDE + below(own)))


_MERGE = {"sum": (F.sum, lambda a, b: a + b), "product": (F.product, lambda a, b: a * b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], totals: Sequence[str] = (), ends: Sequence[float] | None = None, per_range: int = PER_RANGE) -> DataFrame:
    """``rows`` with running values over each series ``by`` in ``order``, a row's own value included.

    ``values`` maps a new column to (sum, product, max or min; what is run over).
    Nulls are passed over and a value is null until there is one that isn't.  Rows that agree in ``order`` are taken
    one after the other.  For the names in ``totals`` there is also ``{name}_total``, the value at
    the series' end.  ``ends`` are those of ranges of the first order
    column, where they are known.
    """
    ends = range_ends(rows, order[0], per_range) if ends is None else ends
    own = {f"_v{k}": value for k, (_, value) in enumerate(values.values())}
    ranged = rows.withColumns({"_range": range_number(as_number(F.col(order[0]), dict(rows.dtypes)[order[0]]), ends), **own})
    inner = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumns({name: _MERGE[how][0](f"_v{k}").over(inner) for k, (name, (how, _)) in enumerate(values.items())})
    names = [*values]
    if not ends:
        whole = {f"{name}_total": _MERGE[values[name][0]][0](f"_v{names.index(name)}").over(Window.partitionBy(*by, "_range")) for name in totals}
        return run.withColumns(whole).drop("_range", *own) if whole else run.drop("_range", *own)
    left = ranged.groupBy(*by, "_range").agg(*(_MERGE[how][0](f"_v{k}").alias(f"_v{k}") for k, (how, _) in enumerate(values.values())))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = left.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_range").alias("_of"), *(_MERGE[how][0](f"_v{k}").over(before).alias(f"_c{k}") for k, (how, _) in enumerate(values.values())), *(_MERGE[values[name][0]][0](f"_v{names.index(name)}").over(Window.partitionBy(*by)).alias(f"{name}_total") for name in totals))
    same = F.col("_range") == F.col("_of")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    met = run.join(carried.hint("merge"), same)
    joined = {name: F.coalesce(_MERGE[how][1](F.col(f"_c{k}"), F.col(name)), F.col(name), F.col(f"_c{k}")) for k, (name, (how, _)) in enumerate(values.items())}
    return met.withColumns(joined).select(*rows.columns, *values, *(f"{name}_total" for name in totals))
