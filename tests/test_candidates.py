"""Last values of candidates from the rows that they rest on, and their rank IC."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions import factors as X
from tidemark.operators import labels as L
from tidemark.operators import search as S

GRID = S.factor_grid(("close", "volume"), (2, 4, 10), (1, 5))


def history(spark):
    rng = random.Random(7)
    rows = [("f%d" % (i % 2), i, dt.date(2024, 1, 1) + dt.timedelta(k), rng.choice([None, *map(float, range(8))]) if i % 5 == 0 else rng.random(), float(rng.randrange(9))) for i in range(40) for k in range(i % 20 + 1)]
    return spark.createDataFrame(rows, "fold_id string, instrument_id long, vt date, close double, volume double")


def test_last_values(spark):
    """The same as all rows' values of which the last ones are kept; the last row is told before there are columns for candidates."""
    bars, by = history(spark), ["fold_id", "instrument_id"]
    found = S.candidate_values(bars, GRID, by)
    every = X.last_rows(X.evaluate(bars, GRID, by), by).join(bars.groupBy(*by).count().filter("count >= 3"), by)
    mine = {tuple(r) for r in found.collect()}
    theirs = {(r["fold_id"], r["instrument_id"], n, r[n], r[n + "_status"]) for r in every.collect() for n in GRID}
    assert mine == theirs
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(k for k, line in enumerate(plan) if "vt#" in line and "DESC" in line and "row_number" in line)
    assert all(k < last for k, line in enumerate(plan) if "var_pop" in line and "Window" in line)


def test_candidate_rank_ic(spark):
    """The same as ranks of candidates' values joined with labels."""
    bars, by = history(spark), ["fold_id", "instrument_id"]
    labels = bars.select(*by).distinct().filter("instrument_id % 7 <> 3").withColumn("fwd", F.pmod(F.col("instrument_id") * 37, F.lit(11)).cast("double"))
    rows = S.candidate_values(bars, GRID, by).filter("status = 'ok'").withColumnRenamed("value", "signal").join(labels, by)
    want = {tuple(r) for r in L.rank_ic(rows, ["fold_id", "candidate"]).withColumn("rank_ic", F.round("rank_ic", 9)).collect()}
    found = S.candidate_rank_ic(bars, GRID, labels).select("fold_id", "candidate", "n", F.round("rank_ic", 9))
    assert {tuple(r) for r in found.collect()} == want and len(want) == 2 * len(GRID)
