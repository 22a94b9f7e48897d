"""Candidate factors in batches, and multiple testing over all of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.factors import Factor, binary, evaluate, field, lag, rolling
from ..session import ship
from .labels import rank_ic
from .ranks import ends_of, medians, range_of


def benjamini_hochberg(trials: DataFrame, alpha: float = 0.05, p: str = "p") -> DataFrame:
    """``trials`` with ``accepted``: false discovery rate ``alpha`` over all rows.

    The cutoff is the largest p whose rank is within the line; equal p share the
    larger rank.  Distinct p are counted first, and ranks are running sums over
    ranges of p that quantiles part evenly: a sum for each range, then one
    within it, so that no task has to hold them all.
    """
    p_of = F.col(p)
    counts = trials.filter(p_of.isNotNull()).groupBy(p_of.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_range", range_of(F.col("_p"), "double", ends_of(trials, p)))
    per = counts.groupBy("_range").agg(F.sum("_n").alias("_in"))  # a row for each range
    before = per.withColumn("_before", F.sum("_in").over(Window.orderBy("_range")) - F.col("_in")).withColumn("_total", F.sum("_in").over(Window.partitionBy()))
    inner = F.sum("_n").over(Window.partitionBy("_range").orderBy("_p"))
    ranked = counts.withColumn("_inner", inner).join(F.broadcast(before), "_range")
    rank = F.col("_before") + F.col("_inner")
    cut = ranked.filter(F.col("_p") <= F.lit(alpha) * rank / F.col("_total")).agg(F.max("_p")).first()[0]
    return trials.withColumn("accepted", F.lit(False) if cut is None else F.coalesce(p_of <= F.lit(cut), F.lit(False)))


def search_artifact(trials: DataFrame, by: str = "lane", score: str = "score", least: float = 0.05) -> DataFrame:
    """(by, best, median, artifact): a best score close to the median is what luck gives."""
    best = trials.groupBy(by).agg(F.max(score).alias("best"), F.count(score).alias("_n"))
    met = best.join(medians(trials, [by], {"median": score}), by, "left")
    return met.select(by, "best", "median", F.coalesce((F.col("_n") >= 2) & (F.col("best") - F.col("median") < least), F.lit(False)).alias("artifact"))


def scorecard(trials: DataFrame, by: str = "lane") -> DataFrame:
    """Lane summaries of trials with valid, score and ic."""
    ok = F.col("valid")
    found = trials.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"),
        F.max(F.when(ok, F.col("score"))).alias("best_score"), F.max(F.when(ok, F.col("ic"))).alias("best_ic"),
    )
    return found.join(medians(trials.filter(ok), [by], {"median_score": "score", "median_ic": "ic"}), by, "left")


def _beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    from math import lgamma

    log = np.array([lgamma(v + b) - lgamma(v) - lgamma(b) for v in a]) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    part = np.exp(log) * h / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - part, part)))


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation by Student's t; 1 for fewer than three pairs."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def p_value(r: pd.Series, k: pd.Series) -> pd.Series:
        r, k = r.to_numpy(float), k.to_numpy(float)
        with np.errstate(all="ignore"):
            free = np.maximum(k - 2, 1.0)
            t2 = np.where(np.abs(r) >= 1, np.inf, r * r * free / np.maximum(1 - r * r, 1e-300))
            p = np.where(np.isinf(t2), 0.0, _beta(free / 2, 0.5, np.where(np.isinf(t2), 0.0, free / (free + t2))))
        return pd.Series(np.where(k < 3, 1.0, np.where(np.isnan(r), np.nan, p)))

    return p_value(rho.cast("double"), n.cast("double"))


def spearman_p_simple(rho: Column, n: Column) -> Column:
    """A coarse p-value in plain expressions: 1 / (1 + t^2) within [1e-6, 1]."""
    t2 = F.when(F.abs(rho) >= 1, F.lit(float("inf"))).otherwise(rho * rho * (n - 2) / F.when(F.abs(rho) < 1, 1 - rho * rho))
    return F.when(n < 3, F.lit(1.0)).otherwise(F.least(F.greatest(1 / (1 + t2), F.lit(1e-6)), F.lit(1.0)))


def factor_grid(fields: Sequence[str] = ("close", "volume", "open", "high", "low"), windows: Sequence[int] = range(2, 11), lags: Sequence[int] = range(1, 6)) -> dict[str, Factor]:
    """Candidates by parameters: rolling statistics of a field, and a field with its own past."""
    out = {f"{op}_{f}_{w}": rolling(op, field(f), w) for f in fields for op in ("mean", "std", "sum") for w in windows}
    out |= {f"{op}_{f}_lag{k}": binary(op, field(f), lag(field(f), k)) for f in fields for op in ("add", "sub", "mul") for k in lags}
    return out


def _last_values(bars: DataFrame, factors: dict[str, Factor], by: Sequence[str], least_rows: int) -> DataFrame:
    """(by, a column and a status for each candidate) of each instrument's last row.

    Only rows that the last value rests on are kept, and which one is last is told on them
    before there is a column for each candidate: wide rows are neither moved nor sorted.
    """
    order = Window.partitionBy(*by)
    told = bars.withColumns({"_place": F.row_number().over(order.orderBy(F.desc("vt"))), "_rows": F.count(F.lit(1)).over(order)})
    kept = told.filter((F.col("_place") <= max(f.lookback for f in factors.values()) + 1) & (F.col("_rows") >= least_rows))
    return evaluate(kept, factors, by).filter("_place = 1").select(*by, *factors, *(f"{n}_status" for n in factors))


def candidate_values(bars: DataFrame, factors: dict[str, Factor], by: Sequence[str] = ("instrument_id",), least_rows: int = 3, labels: DataFrame | None = None) -> DataFrame:
    """(by, candidate, value, status): every candidate's last value, all from one pass over the bars.

    With ``labels`` (by, fwd) it is (by, fwd, candidate, value) of valid values that have a label, where ``candidate`` is its number
    in ``factors``: labels are met by one row an instrument, before there is one for each candidate.
    """
    found, by = _last_values(bars, factors, by, least_rows), list(by)
    if labels is None:
        wide = found.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), F.col(n).alias("value"), F.col(f"{n}_status").alias("status")) for n in factors))).alias("c"))
        return wide.select(*by, "c.candidate", "c.value", "c.status")
    met = found.join(labels.select(*by, "fwd").hint("merge"), by)
    valid = F.array(*(F.when(F.col(f"{n}_status") == "ok", F.struct(F.lit(k).cast("smallint").alias("candidate"), F.col(n).alias("value"))) for k, n in enumerate(factors)))
    return met.select(*by, "fwd", F.explode(valid).alias("c")).filter("c is not null").select(*by, "fwd", "c.candidate", "c.value")


def candidate_rank_ic(bars: DataFrame, factors: dict[str, Factor], labels: DataFrame, by: Sequence[str] = ("fold_id",), least_rows: int = 3) -> DataFrame:
    """(by, candidate, n, rank_ic) of every candidate's valid last values with the ``labels`` (by, instrument_id, fwd).

    A row for each candidate, with its number for its name, is moved once, to be ranked.
    """
    by, names = list(by), list(factors)
    rows = candidate_values(bars, factors, [*by, "instrument_id"], least_rows, labels)
    ic = rank_ic(rows.withColumnsRenamed({"candidate": "_k", "value": "signal"}), [*by, "_k"])
    return ic.select(*by, F.element_at(F.array(*map(F.lit, names)), F.col("_k") + 1).alias("candidate"), "n", "rank_ic")


def score_candidates(values: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """(candidate, score, valid, error): the mean over instruments; one that fails makes the candidate invalid, never absent."""
    bad = F.min(F.when(F.col("status") != "ok", F.col("status")))
    return values.groupBy(*by).agg(F.when(bad.isNull(), F.avg("value")).alias("score"), bad.isNull().alias("valid"), bad.alias("error"))


#: Instruments whose ranks one task multiplies at a time; candidates times sets of instruments are the other side of its matrix.
CHUNK = 2048


def mutual_ic(values: DataFrame, by: Sequence[str] = ("fold_id",), chunk: int | None = None) -> DataFrame:
    """(by, candidate, other, n, rank_ic) of every two candidates, candidate < other, over the instruments that have both values.

    ``values`` are (by, candidate, instrument_id, value), a row each.  Ordinal ranks, ties in the order
    of the id; 0.0 for fewer than two instruments or where the first candidate is constant on them.

    Candidates with values for the same instruments are of one set (told by a count and 128 bits of hash).  A candidate is
    ranked once on what it has in common with each set, not once for each other
    candidate, and products of ranks are summed as matrices over chunks of instruments, so a
    chunk sends a row for each two candidates and none is made for an instrument of a pair.
    With as many sets as candidates there are as many rankings as pairs.
    """
    ship(values.sparkSession)
    by, chunk = list(by), chunk or CHUNK
    rows = values.filter(F.col("value").isNotNull()).select(*by, "candidate", "instrument_id", "value")
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("instrument_id")).cast("decimal(38,0)"))
    sets = rows.groupBy(*by, "candidate").agg(F.concat_ws("/", F.count(F.lit(1)), mark(1), mark(2)).alias("own"))
    tagged = rows.join(sets.hint("merge"), [*by, "candidate"])
    per_row = Window.partitionBy(*by, "instrument_id")
    common = tagged.withColumn("all", F.collect_set("own").over(per_row)).withColumn("met", F.explode("all")).drop("all")
    ranked = common.withColumns({
        "r": F.row_number().over(Window.partitionBy(*by, "candidate", "met").orderBy("value", "instrument_id")).cast("double"),
        "n": F.count(F.lit(1)).over(Window.partitionBy(*by, "candidate", "met")),
        "flat": (F.min("value").over(Window.partitionBy(*by, "candidate", "met")) == F.max("value").over(Window.partitionBy(*by, "candidate", "met"))),
    })
    kinds = {f.name: f for f in values.schema}
    out = StructType([*(kinds[c] for c in by), StructField("candidate", StringType()), StructField("other", StringType()), StructField("n", LongType()), StructField("flat", BooleanType()), StructField("dot", DoubleType())])

    def products(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Sums of the products of centred ranks of every two candidates over a chunk of instruments."""
        part = part.assign(c=part["r"] - (part["n"] + 1) / 2, at=pd.factorize(part["instrument_id"])[0])
        width, cells = part["at"].max() + 1, part.groupby(["own", "met"]).indices
        names = {own: np.sort(of["candidate"].unique()) for own, of in part.groupby("own")}

        def ranks(own: str, met: str) -> tuple[np.ndarray, np.ndarray, int]:
            """The ranks of a set's candidates on what it shares with another, whether each is constant there, and on how many instruments."""
            of = part.iloc[cells[own, met]]
            k, dense, flat = np.searchsorted(names[own], of["candidate"]), np.zeros((len(names[own]), width)), np.zeros(len(names[own]), bool)
            dense[k, of["at"]], flat[k] = of["c"], of["flat"]
            return dense, flat, int(of["n"].iloc[0])

        found = []
        for mine, theirs in cells:
            (a, flat, n), (b, _, _) = ranks(mine, theirs), ranks(theirs, mine)
            i, j = np.nonzero(names[mine][:, None] < names[theirs][None, :])
            found.append(pd.DataFrame({"candidate": names[mine][i], "other": names[theirs][j], "n": n, "flat": flat[i], "dot": (a @ b.T)[i, j]}))
        found = pd.concat(found)
        for k, c in enumerate(by):
            found.insert(k, c, group[k])
        return found

    sized = ranked.withColumn("_most", F.max("n").over(Window.partitionBy(*by, "instrument_id")))
    dealt = sized.withColumn("_chunk", F.pmod(F.xxhash64("instrument_id"), F.lit(1 << 20)) % F.ceil(F.col("_most") / F.lit(chunk)))
    sums = dealt.groupBy(*by, "_chunk").applyInPandas(products, out).groupBy(*by, "candidate", "other").agg(F.max("n").alias("n"), F.max("flat").alias("flat"), F.sum("dot").alias("dot"))
    n = F.col("n").cast("double")
    return sums.select(*by, "candidate", "other", "n", F.when(F.col("flat") | (F.col("n") < 2), F.lit(0.0)).otherwise(12 * F.col("dot") / (n * (n * n - 1))).alias("rank_ic"))


def chronological_split(rows: DataFrame, share: float = 0.8, day: str = "vt") -> DataFrame:
    """``rows`` with ``part``: train up to the calendar day that has ``share`` of all days before it, else test."""
    days = [r[0] for r in rows.select(day).distinct().orderBy(day).collect()]
    if not days:
        return rows.withColumn("part", F.lit("train"))
    cut = days[max(0, int(len(days) * share) - 1)]
    return rows.withColumn("part", F.when(F.col(day) <= F.lit(cut), "train").otherwise("test"))


def boosted_trees(rows: DataFrame, features: Sequence[str], label: str = "fwd", trees: int = 10, depth: int = 3, seed: int = 7) -> DataFrame:
    """Test rows with the ``prediction`` of gradient-boosted trees that were fitted on the earlier days."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    split = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(chronological_split(rows.dropna(subset=[*features, label])))
    model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed).fit(split.filter("part = 'train'"))
    return model.transform(split.filter("part = 'test'")).drop("_x")


def grid_rows(spark: SparkSession, stages: dict[str, dict[str, Sequence]]) -> DataFrame:
    """A campaign's grid: each stage's product of its dimensions, values distinct and sorted, with an id for each row."""
    names = sorted({d for dims in stages.values() for d in dims})
    out = None
    for stage, dims in stages.items():
        rows = spark.createDataFrame([(stage,)], "stage string")
        for name in names:
            values = sorted({str(v) for v in dims.get(name, ())})
            column = F.explode(F.array(*map(F.lit, values))) if values else F.lit(None).cast("string")
            rows = rows.withColumn(name, column)
        out = rows if out is None else out.unionByName(rows)
    key = F.sha2(F.to_json(F.struct("stage", *names)), 256)
    return out.withColumn("row_id", key)
