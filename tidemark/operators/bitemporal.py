"""Facts with a valid time and a knowledge time: what was known at K about t.

A fact's key is (namespace, instrument_id, vt); of its revisions known by K the
highest one counts, whenever it became known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .time_index import dominated, stabbed

KEY = ("namespace", "instrument_id", "vt")
NAMESPACES = ("bar", "fundamental", "corporate_action", "universe", "macro")


def latest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; ranks are limited before the shuffle."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def of_instruments(rows: DataFrame, instruments: Sequence | DataFrame | None, column: str = "instrument_id") -> DataFrame:
    """Rows of the listed instruments; an empty list has no rows, a table of them is a semi-join."""
    if instruments is None:
        return rows
    if isinstance(instruments, DataFrame):
        return rows.join(instruments.select(column), column, "left_semi")
    return rows.filter(F.col(column).isin(*instruments)) if instruments else rows.filter(F.lit(False))


def as_of(rows: DataFrame, known_by, namespace: str | None = None, instruments=None, vt_start=None, vt_end=None, key: Sequence[str] = KEY) -> DataFrame:
    """The visible fact of each key at knowledge time ``known_by`` (a value or a column).

    Filters come before the ranking: a row that isn't known yet must not hide
    another, and they reach the scan.  An inverted range has no rows.
    """
    rows = rows.filter(F.col("kt") <= known_by)
    if namespace is not None:
        rows = rows.filter(F.col("namespace") == namespace)
    if vt_start is not None:
        rows = rows.filter(F.col("vt") >= vt_start)
    if vt_end is not None:
        rows = rows.filter(F.col("vt") <= vt_end)
    return latest(of_instruments(rows, instruments), key, F.col("revision").desc())


def revisions(rows: DataFrame, known_from, known_to) -> DataFrame:
    """Every revision that became known in a range, both ends included."""
    return rows.filter(F.col("kt").between(known_from, known_to))


def visible_folds(rows: DataFrame, folds: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``rows`` that some fold sees, each with the run of folds that see it: ``first_fold`` and ``past_fold``.

    Folds are numbered from 0 by their cutoffs.  A fold sees what is valid and known
    by its cutoff, so a revision is seen from one fold on, until a higher revision of
    its key is.  A row meets its first fold by its day, in a broadcast table of days,
    and is moved once, by its key, whatever the number of folds.  Cutoffs are days from
    1900 on, which bounds the days; facts may be older.
    """
    numbered, early = _numbered(folds), F.lit("1900-01-01").cast("date")
    cutoff = F.to_date("cutoff")
    before = F.coalesce(F.lag(cutoff).over(Window.orderBy("_fold")), F.when(cutoff < early, F.raise_error("cutoffs are days from 1900 on").cast("date")).otherwise(F.date_sub(early, 1)))
    since = numbered.withColumn("_before", before).filter(F.col("_before") < cutoff)
    days = since.select(F.explode(F.sequence(F.date_add("_before", 1), cutoff)).alias("_day"), F.col("_fold").alias("first_fold"), "_folds")  # a row for each day
    timed = rows.withColumn("_day", F.when(F.col("vt").isNotNull() & F.col("kt").isNotNull(), F.greatest(F.to_date("vt"), F.to_date("kt"), early)))
    higher = Window.partitionBy(*key).orderBy(F.col("revision").desc()).rowsBetween(Window.unboundedPreceding, -1)
    run = timed.join(F.broadcast(days), "_day").withColumn("past_fold", F.coalesce(F.min("first_fold").over(higher), F.col("_folds")))
    return run.filter("first_fold < past_fold").select(*rows.columns, "first_fold", "past_fold")


def _numbered(folds: DataFrame) -> DataFrame:
    """Folds with their number and how many there are: a row for each cutoff of a study."""
    order = Window.orderBy("cutoff", "fold_id")
    known = folds.filter(F.col("cutoff").isNotNull())
    return known.select("fold_id", "cutoff", (F.row_number().over(order) - 1).alias("_fold"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).cast("int").alias("_folds"))


def as_of_folds(rows: DataFrame, folds: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The facts that each fold sees: rows are multiplied by their folds after they have been moved (``visible_folds``)."""
    seen = visible_folds(rows, folds, key).withColumn("_fold", F.explode(F.sequence(F.col("first_fold"), F.col("past_fold") - 1)))
    return seen.join(F.broadcast(_numbered(folds)), "_fold").select(*rows.columns, "fold_id", "cutoff")


def fold_totals(rows: DataFrame, folds: DataFrame, by: Sequence[str], sums: dict[str, Column], key: Sequence[str] = KEY) -> DataFrame:
    """(fold_id, cutoff, by, n, sums) of the facts that each fold sees, without a row for each fact and fold.

    A run of folds adds a value where it begins and takes it away where it
    ends; the running sum of these differences is each fold's total.  Sums are of whole
    numbers or decimals, which differences don't round.
    """
    for name, value in sums.items():
        if rows.select(value.alias(name)).schema[0].dataType.typeName() in ("double", "float"):
            raise ValueError(f"{name}: differences of floating numbers aren't exact")
    runs = visible_folds(rows, folds, key).select(*by, "first_fold", "past_fold", F.lit(1).cast("bigint").alias("n"), *(F.coalesce(v, F.lit(0)).alias(c) for c, v in sums.items()))
    names = ["n", *sums]
    edge = lambda at, sign: F.struct(F.col(at).alias("_fold"), *((F.col(c) * sign).alias(c) for c in names))
    steps = runs.select(*by, F.explode(F.array(edge("first_fold", 1), edge("past_fold", -1))).alias("s")).select(*by, "s.*")
    steps = steps.groupBy(*by, "_fold").agg(*(F.sum(c).alias(c) for c in names))
    numbered = _numbered(folds).drop("_folds")
    every = steps.select(*by).distinct().crossJoin(F.broadcast(numbered.select("_fold")))  # a row for each group and fold, as the result has
    dense = steps.unionByName(every, allowMissingColumns=True).groupBy(*by, "_fold").agg(*(F.sum(c).alias(c) for c in names))
    so_far = Window.partitionBy(*by).orderBy("_fold").rowsBetween(Window.unboundedPreceding, 0)  # a row for each fold
    total = dense.withColumns({c: F.sum(c).over(so_far) for c in names}).filter("n > 0")
    return total.join(F.broadcast(numbered), "_fold").select("fold_id", "cutoff", *by, *names)


def violations(rows: DataFrame) -> Column:
    """What a record breaks of its contract, as an array of names."""
    say = lambda bad, name: F.when(bad, F.lit(name))
    return F.array_compact(
        F.array(
            say(F.col("namespace").isNull() | ~F.col("namespace").isin(*NAMESPACES), "namespace"),
            say(F.col("vt").isNull(), "vt"), say(F.col("kt").isNull(), "kt"),
            say(F.col("revision").isNull() | (F.col("revision") < 0), "revision"),
            say(F.col("instrument_id").isNull(), "instrument_id"),
        )
    )


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; the bad ones name their violations."""
    checked = rows.withColumn("violations", violations(rows))
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def duplicate_keys(new: DataFrame, existing: DataFrame | None = None, key: Sequence[str] = (*KEY, "revision")) -> DataFrame:
    """Keys that an append must refuse: repeated in ``new`` or there already."""
    twice = new.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1").select(*key)
    return twice if existing is None else twice.unionByName(new.join(existing, list(key), "left_semi").select(*key)).distinct()


def depth(rows: DataFrame, min_instruments: int = 4, min_days: int = 10, namespaces: Sequence[str] = ("bar", "universe")) -> DataFrame:
    """One row (ok, message): is there enough in the store to run?  The first failing check names itself."""
    bar = F.col("namespace") == "bar"
    early = (F.col("kt") < F.col("vt")) & ~F.col("namespace").isin("corporate_action", "universe")
    seen = rows.agg(
        F.collect_set("namespace").alias("have"), F.count_distinct(F.when(bar, F.col("instrument_id"))).alias("instruments"),
        F.count_distinct(F.when(bar, F.col("vt"))).alias("days"), F.count_if(early).alias("early"),
    )
    missing = F.array_except(F.array(*map(F.lit, sorted(namespaces))), F.coalesce("have", F.array().cast("array<string>")))
    message = (
        F.when(F.size(missing) > 0, F.concat(F.lit("no rows of "), F.concat_ws("+", F.array_sort(missing))))
        .when(F.col("instruments") < min_instruments, F.concat(F.lit("instruments "), F.col("instruments"), F.lit(f"/{min_instruments}")))
        .when(F.col("days") < min_days, F.concat(F.lit("days "), F.col("days"), F.lit(f"/{min_days}")))
        .when(F.col("early") > 0, F.concat(F.lit("known too early "), F.col("early")))
        .otherwise(F.concat(F.lit("ok "), F.col("instruments"), F.lit("/"), F.col("days"), F.lit("/"), F.size("have")))
    )
    return seen.select(message.startswith("ok").alias("ok"), message.alias("message"))


def edges_as_of(edges: DataFrame, vt, kt) -> DataFrame:
    """Edges that are valid at ``vt`` and known by ``kt``."""
    return edges.filter((F.col("valid_from") <= vt) & (F.col("valid_to") >= vt) & (F.col("known_at") <= kt))


def edges_at_points(edges: DataFrame, points: DataFrame, on: Sequence[str]) -> DataFrame:
    """Edges for many (vt, kt) points: they meet by equality of ``on`` and a node of time (``time_index.stabbed``).

    Points without a ``kt`` know what is known at vt: an edge holds from where it
    is both valid and known.  Where the times differ, the knowledge time is looked at
    in the pairs that meet in valid time.
    """
    if "kt" in points.columns:
        return stabbed(points, edges, on, "vt", "valid_from", "valid_to").filter("known_at <= kt")
    known = edges.filter(F.col("known_at").isNotNull()).withColumn("_from", F.greatest("valid_from", "known_at"))
    return stabbed(points, known.filter(F.col("valid_from").isNotNull()), on, "vt", "_from", "valid_to").drop("_from")


def edges_as_records(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.lit("universe").alias("namespace"), F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")).alias("instrument_id"),
        F.col("valid_from").alias("vt"), F.col("known_at").alias("kt"), F.lit(0).alias("revision"),
        F.struct("kind", "src", "dst", "valid_to").alias("payload"),
    )


def split_ratio(points: DataFrame, splits: DataFrame, key: str = "instrument_id") -> DataFrame:
    """``points`` (key, vt, kt, ...) with the product of the ratios of splits in effect and known; 1.0 where there is none."""
    found = dominated(points, splits, key, ("vt", "kt"), {"split_ratio": ("product", F.col("ratio"))})
    return found.withColumn("split_ratio", F.coalesce("split_ratio", F.lit(1.0)))


def split_count(points: DataFrame, splits: DataFrame, key: str = "instrument_id") -> DataFrame:
    """``points`` (key, vt, kt, ...) with the number of splits in effect and known."""
    found = dominated(points, splits, key, ("vt", "kt"), {"n_splits": ("sum", F.when(F.col("ratio").isNotNull(), 1).otherwise(0))})
    return found.withColumn("n_splits", F.coalesce("n_splits", F.lit(0)).cast("bigint"))


def apply_split(price: Column, ratio: Column, mode: str) -> Column:
    """A price as it was ("Raw") or divided by the split ratio ("SplitAdjusted")."""
    if mode not in ("Raw", "SplitAdjusted"):
        raise ValueError(f"unknown price mode {mode!r}")
    return price if mode == "Raw" else F.try_divide(price, ratio)


def known_join(left: DataFrame, right: DataFrame, key: str, value: str, revision: str = "revision") -> DataFrame:
    """``left`` (key, vt, ...) with the ``value`` of the right fact that has the latest vt of those valid and known at vt.

    Of that fact's revisions the highest one known counts, and the value keeps
    its type.  Both sides are one sorted stream per instrument: a right row joins
    the stream where it is both valid and known, and the largest (vt, revision)
    so far carries on, so a restatement takes over when it becomes known and a
    late row of an older fact is passed over.
    """
    known = right.filter(F.col("vt").isNotNull() & F.col("kt").isNotNull())
    b = known.select(F.col(key), F.greatest("vt", "kt").alias("_at"), F.lit(0).alias("_side"), F.struct(F.col("vt"), F.col(revision).alias("revision"), F.col(value).alias("value")).alias("_fact"))
    a = left.select("*", F.col("vt").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(b.schema["_fact"].dataType).alias("_fact"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max("_fact").over(order)
    return both.withColumn("_best", best).filter("_side = 1").select(*left.columns, F.col("_best.vt").alias(f"{value}_vt"), F.col("_best.value").alias(value))


def restated(rows: DataFrame, before, after, value: str = "value", key: Sequence[str] = KEY) -> DataFrame:
    """Facts that differ between what was known at two times: one pass over the rows, no join of two reads."""
    best = lambda k: F.max(F.when(F.col("kt") <= k, F.struct("revision", value)))
    both = rows.filter(F.col("kt") <= F.greatest(F.lit(before), F.lit(after))).groupBy(*key).agg(best(F.lit(before)).alias("a"), best(F.lit(after)).alias("b"))
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(*key, F.col(f"a.{value}").alias("old_value"), F.col(f"b.{value}").alias("new_value"))
