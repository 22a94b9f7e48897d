"""Causal factor expressions over instrument histories, as staged window columns.

``lag(field("close"), 1)`` and the like are Python functions that name columns
of a ``Panel``.  Each level is a named column, so shared parts are computed once
and all windows share one sort of one exchange.  Windows count rows, not days.

A value that can't be had is null, and its status says why: the innermost of
``insufficient_history``, ``missing_field``, ``domain_error`` and
``division_by_zero``; else ``ok``.  Variances are population variances and a
window that doesn't vary has variance exactly 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field as _field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import placed


class Panel:
    """Rows with an instrument and an order; stages columns level by level."""

    def __init__(self, rows: DataFrame, by: Sequence[str] = ("instrument_id",), order: str = "vt", status: bool = True):
        self.by, self.order, self.with_status = tuple(by), order, status
        self.window = Window.partitionBy(*by).orderBy(order)
        self.columns = set(rows.columns)
        self.levels: list[dict[str, Column]] = [{"_t": F.row_number().over(self.window).cast("double")}]
        self.rows, self.names = rows, {"_t": ("_t", 0)}
        self.made: dict[Factor, tuple] = {}
        self.needed: dict[Factor, dict] = {}

    def value(self, e: Factor) -> tuple[str, int, Column, Column]:
        """What ``e.make`` gives, made once."""
        if e not in self.made:
            self.made[e] = e.make(self)
        return self.made[e]

    def needs(self, e: Factor) -> dict[str, tuple[int, Column]]:
        """What ``e.has`` gives, made once."""
        if e not in self.needed:
            self.needed[e] = e.has(self)
        return self.needed[e]

    def stage(self, key: str, below: int, column: Column) -> str:
        """The name of a column that reads names of level ``below`` and lower."""
        if key not in self.names:
            name = f"_s{len(self.names)}"
            while len(self.levels) <= below + 1:
                self.levels.append({})
            self.levels[below + 1][name] = column
            self.names[key] = (name, below + 1)
        return self.names[key][0]

    def frame(self, w: int):
        return self.window.rowsBetween(-(w - 1), 0)

    def done(self) -> DataFrame:
        out = self.rows
        for level in self.levels:
            if level:
                out = out.withColumns(level)
        return out


@dataclass(frozen=True)
class Factor:
    """An expression: ``make(panel)`` gives (key, level, value, status); ``lookback`` is the rows that it reaches back.

    ``has(panel)`` gives the conditions, {key: (level, Column)}, that all hold in the rows where there is a value, and
    stages no values but those that divide or have a logarithm taken.  A condition is never null.  No value is below
    ``floor``, if there is one, so that a divisor with a floor over 0 needs no look.
    """

    make: Callable = _field(repr=False)
    has: Callable = _field(repr=False)
    lookback: int = 0
    universe: str | None = None
    root_only: bool = False
    floor: float | None = None


def _ok() -> Column:
    return F.lit(None).cast("string")


def _first(*status: Column) -> Column:
    return F.coalesce(*status) if len(status) > 1 else status[0]


def _inner(*parts: Factor) -> tuple[int, str | None]:
    if any(p.root_only for p in parts):
        raise ValueError("a cross-section can only stand outermost")
    universes = {p.universe for p in parts if p.universe}
    if len(universes) > 1:
        raise ValueError(f"universes can't be mixed: {sorted(universes)}")
    return max(p.lookback for p in parts), next(iter(universes), None)


def _holds(p: Panel, key: str, level: int, condition: Column) -> dict[str, tuple[int, Column]]:
    """The condition that this one is true, staged."""
    name = p.stage(key, level, F.coalesce(condition, F.lit(False)))
    return {key: (p.names[key][1], F.col(name))}


def _all(conditions: dict[str, tuple[int, Column]]) -> tuple[str, int, Column]:
    """(key, level, Column) of all conditions together."""
    column = reduce(lambda a, b: a & b, (conditions[key][1] for key in sorted(conditions)), F.lit(True))
    return " and ".join(sorted(conditions)), max((level for level, _ in conditions.values()), default=-1), column


def _whole(p: Panel, conditions: dict[str, tuple[int, Column]], w: int) -> dict[str, tuple[int, Column]]:
    """The condition that all of these hold in each of the last ``w`` rows."""
    key, level, column = _all(conditions)
    name, level = _known(p, f"has {key}", max(level, 0), lambda: F.when(column, 1))
    return {f"{name} >= {w}": (level, F.col(name) >= w)}


def const(v: float) -> Factor:
    return Factor(lambda p: (f"c{float(v)!r}", -1, F.lit(float(v)), _ok()), lambda p: {}, floor=float(v))


def field(name: str) -> Factor:
    """A column of the rows as a double; status ``missing_field`` where there is no such column or it is null."""

    def make(p: Panel):
        if name.split(".")[0] not in p.columns:
            return f"f{name}", -1, F.lit(None).cast("double"), F.lit("missing_field")
        value = F.col(name).cast("double")
        return f"f{name}", -1, value, F.when(value.isNull(), F.lit("missing_field"))

    def has(p: Panel):
        key, level, value, _ = make(p)
        return {key: (level, value.isNotNull())}

    return Factor(make, has)


def fundamental(name: str, declared_lag: int, required_lag: int = 45) -> Factor:
    """A reported figure; refused if it is declared to be known sooner than it can be."""
    if declared_lag < required_lag:
        raise ValueError(f"{name}: a lag of {declared_lag} days is shorter than {required_lag}")
    return field(name)


def unary(op: str, e: Factor) -> Factor:
    ops = {"neg": lambda x: -x, "abs": F.abs, "log": F.ln, "sign": lambda x: F.when(F.isnan(x), 0.0).otherwise(F.signum(x))}
    if op not in ops:
        raise ValueError(f"unknown unary operator {op!r}")
    look, universe = _inner(e)

    def make(p: Panel):
        key, level, x, status = p.value(e)
        if op == "log":
            return f"log({key})", level, F.when(x > 0, F.ln(x)), _first(status, F.when(x <= 0, F.lit("domain_error")))
        return f"{op}({key})", level, ops[op](x), status

    def has(p: Panel):
        if op != "log":
            return p.needs(e)
        key, level, x, _ = p.value(e)
        return _holds(p, f"{key} > 0", level, x > 0)

    return Factor(make, has, look, universe, floor=0.0 if op == "abs" else None)


def binary(op: str, a: Factor, b: Factor) -> Factor:
    ops = {
        "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.try_divide(x, y),
        "signed_power": lambda x, y: F.signum(x) * F.pow(F.abs(x), y),
        "min": lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)), "max": lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)),
        "gt": lambda x, y: (x > y).cast("double"), "lt": lambda x, y: (x < y).cast("double"),
    }
    if op not in ops:
        raise ValueError(f"unknown binary operator {op!r}")
    look, universe = _inner(a, b)

    def below(p: Panel):
        kb, lb, y, sb = p.value(b)
        if op == "div" and kb in ("c0.0", "c-0.0"):
            raise ValueError("division by a literal zero")
        return kb, lb, y, sb

    def make(p: Panel):
        ka, la, x, sa = p.value(a)
        kb, lb, y, sb = below(p)
        own = [F.when(y == 0, F.lit("division_by_zero"))] if op == "div" else [F.when((x == 0) & (y < 0), F.lit("domain_error"))] if op == "signed_power" else []
        value = ops[op](x, y)
        if op == "signed_power":
            value = F.when((x != 0) | (y >= 0), value)
        return f"{op}({ka},{kb})", max(la, lb), value, _first(sa, sb, *own)

    def has(p: Panel):
        if op == "div" and (b.floor is None or b.floor <= 0):
            kb, lb, y, _ = below(p)
            implied = p.needs(b)  # a divisor that isn't 0 is there
            return {key: own for key, own in p.needs(a).items() if key not in implied} | _holds(p, f"{kb} <> 0", lb, y != 0)
        if op == "signed_power":
            (ka, la, x, _), (kb, lb, y, _) = p.value(a), p.value(b)
            return p.needs(a) | p.needs(b) | _holds(p, f"{ka} <> 0 or {kb} >= 0", max(la, lb), (x != 0) | (y >= 0))
        return p.needs(a) | p.needs(b)

    floor = a.floor + b.floor if op == "add" and None not in (a.floor, b.floor) else None
    return Factor(make, has, look, universe, floor=floor)


def lag(e: Factor, n: int) -> Factor:
    """The value ``n`` rows ago; a look ahead is refused."""
    if n < 0:
        raise ValueError("a negative lag looks ahead")
    look, universe = _inner(e)
    if n == 0:
        return e

    def make(p: Panel):
        key, level, x, status = p.value(e)
        at, own = p.stage(key, level, x), f"lag({key},{n})"
        value = F.lag(at, n).over(p.window)
        short = F.when(F.col("_t") <= n, F.lit("insufficient_history"))
        before = F.lag(p.stage("status " + key, level, status), n).over(p.window) if p.with_status else _ok()
        level = p.names[key][1]
        name = p.stage(own, level, value)
        said = F.col(p.stage("status " + own, level, _first(before, short))) if p.with_status else _ok()
        return own, p.names[own][1], F.col(name), said

    def has(p: Panel):
        key, level, column = _all(p.needs(e))
        key = f"has {key}"
        at, own = p.stage(key, level, column), f"lag({key},{n})"
        name = p.stage(own, p.names[key][1], F.lag(at, n, False).over(p.window))
        return {own: (p.names[own][1], F.col(name))}

    return Factor(make, has, look + n, universe)


#: Windows up to BASE rows are read row by row; longer ones are put together of windows of the largest of UNITS that is shorter.
BASE, UNITS = 8, (60, 5)
#: Levels above a column's own at which its windows up to UNITS[0] rows stand: short ones, their lags, and four of pairs.
DEPTH = 6


def _unit(w: int) -> int:
    return next(u for u in UNITS if u < w)


def _parts(w: int) -> list[tuple[int, int]]:
    """(rows, rows after them) of the parts of a window, the latest first."""
    unit = _unit(w)
    return [(min(unit, w - after), after) for after in range(0, w, unit)]


def _before(p: Panel, at: tuple[str, int], n: int, default: float | None = None) -> tuple[str, int]:
    """A staged column ``n`` rows ago."""
    if n == 0:
        return at
    key = f"{at[0]} before {n}"
    return p.names[key] if key in p.names else (p.stage(key, at[1], F.lag(at[0], n, default).over(p.window)), p.names[key][1])


def _own(p: Panel, level: int, at: tuple[str, int], unit: int) -> tuple[str, int]:
    """A unit's window at the level from which its lags are taken, the same for all statistics."""
    return (at[0], max(at[1], level + DEPTH)) if unit == UNITS[0] else at


@dataclass(frozen=True)
class Folded:
    """A statistic of windows over one column, staged; windows that follow one another are put together in pairs.

    ``join`` ((name, rows, rows after) of the later part, the same of the earlier one, their unit) gives SQL and the
    levels that it reads.  Pairs are the same for all windows, so these take two passes over the rows in all, and a third
    if any has over 60 rows.  With a ``default`` no part is null, which keeps the generated code small enough to be compiled.
    """

    panel: Panel
    name: str
    level: int
    part: Callable[[], Column]
    join: Callable
    default: float | None = None
    scale: bool = False

    def window(self, w: int) -> tuple[str, int]:
        """The staged column of the last ``w`` rows, and its level."""
        if w > BASE:
            return self.span(w, 0, _unit(w))
        own = f"{self.name},{w}"
        if own not in self.panel.names:
            value = self.part().over(self.panel.frame(w))
            if self.scale:
                value = value * w
            self.panel.stage(own, self.level, value if self.default is None else F.coalesce(value, F.lit(self.default)))
        return self.panel.names[own]

    def span(self, rows: int, after: int, unit: int) -> tuple[str, int]:
        """The staged column of ``rows`` rows that ``after`` rows follow."""
        p = self.panel
        if rows <= unit:
            return _before(p, _own(p, self.level, self.window(rows), unit), after, self.default)
        own = f"{self.name},{rows} before {after}"
        if own not in p.names:
            cut = unit << ((rows - 1) // unit).bit_length() - 1
            late, early = self.span(cut, after, unit), self.span(rows - cut, after + cut, unit)
            value, *levels = self.join((late[0], cut, after), (early[0], rows - cut, after + cut), unit)
            p.stage(own, max(late[1], early[1], *levels), F.expr(value))
        return p.names[own]


def _sum(p: Panel, key: str, level: int, part: Column) -> Folded:
    return Folded(p, f"sum({key})", level, lambda: F.sum(part), lambda a, b, _: (f"{a[0]} + {b[0]}",), 0.0)


def _end(p: Panel, op: str, key: str, level: int, part: Column) -> Folded:
    name, end = ("greatest", F.max) if op.endswith("max") else ("least", F.min)
    return Folded(p, f"{op}({key})", level, lambda: end(part), lambda a, b, _: (f"{name}({a[0]}, {b[0]})",))


def _known(p: Panel, key: str, level: int, part: Callable[[], Column]) -> tuple[str, int]:
    """The staged number of rows since the last one that lacks a value: windows up to that are whole."""
    own = f"known({key})"
    if own not in p.names:
        last = F.max(F.when(part().isNull(), F.col("_t"))).over(p.window.rowsBetween(Window.unboundedPreceding, 0))
        p.stage(own, level, F.col("_t") - F.coalesce(last, F.lit(0.0)))
    return p.names[own]


def _mean(p: Panel, key: str, level: int, part: Column) -> Folded:
    # exact where the parts are equal
    return Folded(p, f"mean({key})", level, lambda: F.avg(part), lambda a, b, _: (f"{a[0]} + ({b[0]} - {a[0]}) * {b[1] / (a[1] + b[1])!r}D",), 0.0)


def _comoment(p: Panel, name: str, level: int, part: Callable[[], Column], means: Sequence[Folded | None]) -> Folded:
    """The sum of the product of two deviations from their means, merged without subtracting large sums."""

    def join(a, b, unit):
        terms, levels = f"{a[1] * b[1] / (a[1] + b[1])!r}D", []
        for mean in means:
            if mean is None:  # the number of the row: means are the middles
                terms += f" * {(a[1] + b[1]) / 2!r}D"
            else:
                x, y = mean.span(*a[1:], unit), mean.span(*b[1:], unit)
                levels += [x[1], y[1]]
                terms += f" * ({x[0]} - {y[0]})"
        return f"{a[0]} + {b[0]} + {terms}", *levels

    return Folded(p, name, level, part, join, 0.0, scale=True)


def _run(p: Panel, key: str, level: int, w: int, v: Column) -> tuple[str, int]:
    """The staged values of ``w`` rows in ascending order: short runs are sorted, longer ones are merged of those.

    A run is null before row ``w`` if it is merged and, so that sorting has no nulls
    to look for, has NaN for a missing value; callers drop windows that lack one.
    """
    own = f"run({key},{w})"
    if own in p.names:
        return p.names[own]
    if w <= BASE:
        values = [F.coalesce(F.lag(v, k).over(p.window) if k else v, F.lit(float("nan"))) for k in range(w)]
        return p.stage(own, level, F.sort_array(F.array(*values))), p.names[own][1]
    parts = [_before(p, _own(p, level, _run(p, key, level, rows, v), _unit(w)), after) for rows, after in _parts(w)]
    return p.stage(own, max(x[1] for x in parts), F.expr(f"sort_array(concat({', '.join(x[0] for x in parts)}))")), p.names[own][1]


def _extreme(p: Panel, op: str, key: str, level: int, v: Column) -> Folded:
    """The (value, row) of the largest or smallest of the rows, the earliest of equal ones."""
    return _end(p, op, key, level, F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("_t") if op == "idxmax" else F.col("_t")).alias("t"))))


ROLLING = ("mean", "sum", "std", "rank", "slope", "residual", "rsquare", "max", "min", "idxmax", "idxmin", "quantile")


def rolling(op: str, e: Factor, w: int, q: float | None = None) -> Factor:
    """A statistic of the last ``w`` rows; null until all of them have a value."""
    if op not in ROLLING:
        raise ValueError(f"unknown rolling operator {op!r}")
    if w < 1:
        raise ValueError("a window has at least one row")
    if (q is not None) != (op == "quantile") and not (op == "quantile" and q is None):
        raise ValueError("only a quantile takes q")
    q = 0.5 if op == "quantile" and q is None else q
    if q is not None and not 0 <= q <= 1:
        raise ValueError("q is from 0 to 1")
    look, universe = _inner(e)

    def make(p: Panel):
        key, level, x, status = p.value(e)
        v = F.col(p.stage(key, level, x))
        said = p.stage("status " + key, level, status) if p.with_status else None
        level, frame = p.names[key][1], p.frame(w)
        top, got = level + 1, []

        def of(at: tuple[str, int]) -> Column:
            got.append(at[1])
            return F.col(at[0])

        mean, n = _mean(p, key, level, v), of(_known(p, key, level, lambda: v))
        m2 = _comoment(p, f"m2({key})", level, lambda: F.var_pop(v), (mean, mean))
        if op == "mean":
            value = of(mean.window(w))
        elif op == "sum":
            value = of(_sum(p, key, level, v).window(w))
        elif op == "std":
            value = F.sqrt(of(m2.window(w)) / w)
        elif op in ("max", "min"):
            value = of(_end(p, op, key, level, v).window(w))
        elif op in ("slope", "residual", "rsquare"):
            cov = of(_comoment(p, f"cov_t({key})", level, lambda: F.covar_pop(v, F.col("_t")), (mean, None)).window(w)) / w if w > 1 else F.lit(0.0)
            slope = cov / F.lit((w * w - 1) / 12) if w > 1 else F.lit(0.0)
            if op == "slope":
                value = slope
            elif op == "residual":
                value = v - (of(mean.window(w)) + slope * F.lit((w - 1) / 2))
            else:
                var = of(m2.window(w)) / w
                value = F.when(var > 0, cov * cov / (var * F.lit((w * w - 1) / 12))).otherwise(0.0) if w > 1 else F.lit(0.0)
        elif op == "rank":  # the place of the last of equal values
            value = (F.lit(w + 1) - F.array_position(F.reverse(of(_run(p, key, level, w, v))), v)) / F.lit(w)
        elif op == "quantile":
            value = F.get(of(_run(p, key, level, w, v)), F.lit(int(q * (w - 1))))
        else:
            row = of(_extreme(p, op, key, level, v).window(w)).getField("t")
            value = (-row if op == "idxmax" else row) - (F.col("_t") - (w - 1))
        own = f"{op}({key},{w},{q})"
        value = F.when(n >= w, value)
        top = max(top, *got)
        if said:
            earlier = F.first(said, ignorenulls=True).over(frame)
            said = F.col(p.stage("status " + own, top, F.coalesce(earlier, F.when(F.col("_t") < w, F.lit("insufficient_history")))))
        name = p.stage(own, top, value)
        return own, p.names[own][1], F.col(name), said if p.with_status else _ok()

    floor = 0.0 if op == "sum" and e.floor is not None and e.floor >= 0 else None
    return Factor(make, lambda p: _whole(p, p.needs(e), w), look + w - 1, universe, floor=floor)


PAIRS = ("cov", "slope", "residual", "rsquare", "corr")


def rolling_pair(op: str, left: Factor, right: Factor, w: int) -> Factor:
    """A statistic of two values over the last ``w`` rows; slope and residual are of right on left."""
    if op not in PAIRS:
        raise ValueError(f"unknown pair operator {op!r}")
    if w < 2:
        raise ValueError("a pair's window has at least two rows")
    look, universe = _inner(left, right)

    def make(p: Panel):
        ka, la, x, sa = p.value(left)
        kb, lb, y, sb = p.value(right)
        x, y = F.col(p.stage(ka, la, x)), F.col(p.stage(kb, lb, y))
        level, frame, pair = max(p.names[ka][1], p.names[kb][1]), p.frame(w), f"({ka},{kb},{w})"
        both, key, got = x.isNotNull() & y.isNotNull(), f"{ka},{kb}", []

        def of(at: tuple[str, int]) -> Column:
            got.append(at[1])
            return F.col(at[0])

        in_x, in_y = F.when(both, x), F.when(both, y)
        mean_x, mean_y = _mean(p, key + " left", level, in_x), _mean(p, key + " right", level, in_y)
        n, cov = of(_known(p, key, level, lambda: F.when(both, 1))), of(_comoment(p, f"cov({key})", level, lambda: F.covar_pop(x, y), (mean_x, mean_y)).window(w))
        m2_x, m2_y = (_comoment(p, f"m2({key} {side})", level, lambda v=v: F.var_pop(v), (mean, mean)) for side, v, mean in (("left", in_x, mean_x), ("right", in_y, mean_y)))
        share = lambda below: F.coalesce(F.try_divide(cov, below), F.lit(0.0))  # noqa: E731  0 where a side doesn't vary
        if op == "cov":
            value = cov / w
        elif op == "slope":
            value = share(of(m2_x.window(w)))
        elif op == "residual":
            value = y - (of(mean_y.window(w)) + share(of(m2_x.window(w))) * (x - of(mean_x.window(w))))
        else:
            corr = share(F.sqrt(of(m2_x.window(w))) * F.sqrt(of(m2_y.window(w))))
            value = corr if op == "corr" else corr * corr
        own, top = f"pair {op}{pair}", max(level + 1, *got)
        name = p.stage(own, top, F.when(n >= w, value))
        said = _ok()
        if p.with_status:
            inner = F.first(p.stage("status " + ka, la, sa), ignorenulls=True).over(frame), F.first(p.stage("status " + kb, lb, sb), ignorenulls=True).over(frame)
            said = F.col(p.stage("status " + own, top, F.coalesce(*inner, F.when(F.col("_t") < w, F.lit("insufficient_history")))))
        return own, p.names[own][1], F.col(name), said

    return Factor(make, lambda p: _whole(p, p.needs(left) | p.needs(right), w), look + w - 1, universe)


def evaluate(rows: DataFrame, factors: dict[str, Factor], by: Sequence[str] = ("instrument_id",), order: str = "vt", status: bool = True) -> DataFrame:
    """``rows`` with a column for each factor and, if wanted, ``<name>_status``."""
    panel = Panel(rows, by, order, status)
    out = {}
    for name, factor in factors.items():
        if factor.root_only:
            raise ValueError("a cross-section is evaluated by cross_section()")
        _, _, value, said = panel.value(factor)
        out[name] = value
        if status:
            out[f"{name}_status"] = F.coalesce(said, F.when(value.isNull(), F.lit("insufficient_history")), F.lit("ok"))
    return panel.done().select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def presence(rows: DataFrame, factors: dict[str, Factor], by: Sequence[str] = ("instrument_id",), order: str = "vt") -> tuple[DataFrame, dict[str, str]]:
    """(``by`` and ``order`` with a boolean for each different need, its name for each factor): where ``evaluate`` has a value.

    Told row by row by what a value needs, without computing it: its fields, whole
    windows, divisors that aren't 0 and logarithms of positive numbers.
    """
    panel, columns, names = Panel(rows, by, order, status=False), {}, {}
    for name, factor in factors.items():
        if factor.root_only:
            raise ValueError("a cross-section is evaluated by cross_section()")
        key, _, column = _all(panel.needs(factor))
        names[name] = columns.setdefault(key, (f"_p{len(columns)}", column))[0]
    return panel.done().select(*by, order, *(column.alias(n) for n, column in columns.values())), names


def last_rows(rows: DataFrame, by: Sequence[str] = ("instrument_id",), order: str = "vt") -> DataFrame:
    """Each instrument's latest row, which may be an old one."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def keep_lookback(rows: DataFrame, lookback: int, by: Sequence[str] = ("instrument_id",), order: str = "vt") -> DataFrame:
    """The last ``lookback + 1`` rows of each instrument: all that its last value rests on."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("_n") <= lookback + 1).drop("_n")


def cross_section(op: str, e: Factor, universe: str) -> Factor:
    """``rank`` or ``zscore`` of the instruments' last values; stands outermost."""
    if op not in ("rank", "zscore"):
        raise ValueError(f"unknown cross-section operator {op!r}")
    if not universe:
        raise ValueError("a cross-section needs a universe")
    look, inner = _inner(e)
    if inner and inner != universe:
        raise ValueError("universes can't be mixed")
    return Factor(e.make, e.has, look, universe, root_only=True)


def evaluate_cross_section(rows: DataFrame, op: str, e: Factor, group: Sequence[str] = (), key: str = "instrument_id", order: str = "vt") -> DataFrame:
    """(group, key, value, cs): each instrument's last value and its place among them.

    Rank is the ordinal position over the number, ties in the order of the key;
    zscore is 0 where the values don't vary.  An instrument without a value has
    no place and isn't counted.
    """
    by = [*group, key]
    last = last_rows(evaluate(keep_lookback(rows, e.lookback, by, order), {"value": e}, by, order, status=False), by, order)
    last = last.filter("value is not null and not isnan(value)")
    if op == "rank":
        return placed(last, ["value", key], group, "_place", "_of").select(*by, order, "value", (F.col("_place") / F.col("_of")).alias("cs"))
    if op != "zscore":
        raise ValueError(f"unknown cross-section operator {op!r}")
    moments = last.groupBy(*group).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_spread"))
    met = last.join(moments.hint("broadcast" if not group else "merge"), list(group)) if group else last.crossJoin(F.broadcast(moments))  # one row
    at = F.when(F.col("_spread") > 0, (F.col("value") - F.col("_mean")) / F.when(F.col("_spread") > 0, F.col("_spread"))).otherwise(0.0)
    return met.select(*by, order, "value", at.alias("cs"))
