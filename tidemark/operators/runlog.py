"""Views of append-only logs of attempts, receipts and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States and the changes between them that are allowed.
TERMINAL = ("completed", "rejected", "failed", "cancelled", "crashed")
ATTEMPT_MOVES = {"issued": ("queued", "cancelled"), "queued": ("running", "cancelled"), "running": TERMINAL}
LADDER_MOVES = {
    "IDLE": ("SEALED",), "SEALED": ("RUNNING",), "RUNNING": ("SCORED",), "SCORED": ("REVIEW", "REJECTED"), "REVIEW": ("PAPER", "REJECTED"),
    "PAPER": ("TINY_LIVE", "IDLE"), "TINY_LIVE": ("IDLE",), "REJECTED": ("IDLE",),
}


def latest_state(log: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def next_retry(log: DataFrame, by: Sequence[str] = ("work_order",)) -> DataFrame:
    return log.groupBy(*by).agg((F.coalesce(F.max("retry_seq"), F.lit(-1)) + 1).alias("next_retry"))


def illegal_moves(log: DataFrame, by: Sequence[str], order: str, moves: dict[str, Sequence[str]], first: str) -> DataFrame:
    """Log entries whose state can't follow the one before; the first of each key must be ``first``."""
    before = F.lag("state").over(Window.partitionBy(*by).orderBy(order))
    allowed = F.lit(False)
    for state, after in moves.items():
        allowed |= (F.col("previous") == state) & F.col("state").isin(*after)
    checked = log.withColumn("previous", before)
    return checked.filter(F.when(F.col("previous").isNull(), F.col("state") != first).otherwise(~allowed))


def authority_faults(log: DataFrame, by: str = "candidate", order: str = "seq") -> DataFrame:
    """Approvals before a review, and those after the first, of a log with ``event`` review or approve."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = log.withColumns({"_reviews": F.sum((F.col("event") == "review").cast("int")).over(so_far), "_approvals": F.sum((F.col("event") == "approve").cast("int")).over(so_far)})
    fault = F.when(F.col("_reviews") == 0, "before_review").when(F.col("_approvals") > 1, "duplicate")
    return counted.filter("event = 'approve'").withColumn("fault", fault).filter("fault is not null").drop("_reviews", "_approvals")


def insert_missing(existing: DataFrame, new: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """Rows of ``new`` to append: the first of each key that ``existing`` doesn't have."""
    return latest_state(new.join(existing, list(key), "left_anti"), key, *order)


def receipt_outcomes(log: DataFrame, by: str = "work_order", order: str = "seq", receipts: Sequence[str] = ("completed", "failed")) -> DataFrame:
    """Each receipt of a log of attempts with ``outcome``.

    A receipt counts if its attempt is running when it comes, and ends it; so
    the entry before it must be the one that set the attempt running.  A second
    receipt of an attempt, or one that comes before it runs, is invalid.  The
    first completed one of a work order is committed and later ones, of other
    attempts, are superseded; the rest only end their attempt.
    """
    before = F.lag("state").over(Window.partitionBy(by, "retry_seq").orderBy(order))
    met = log.withColumn("_runs", F.coalesce(before == "running", F.lit(False))).filter(F.col("state").isin(*receipts))
    good = F.col("_runs") & (F.col("state") == "completed")
    place = F.sum(good.cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(~F.col("_runs"), "invalid").when(good & (F.col("_place") == 1), "committed").when(good, "superseded_duplicate").otherwise("ended")
    return met.withColumn("_place", place).withColumn("outcome", outcome).drop("_place", "_runs")


def begin_once(events: DataFrame, key: str = "idempotency_key", order: str = "seq") -> DataFrame:
    """The first begin event of each key: beginning again gives the same run."""
    return latest_state(events, [key], F.col(order))


def finalize_conflicts(events: DataFrame, by: str, order: str, value: Sequence[str], refused: Column | None = None) -> DataFrame:
    """Finalize events with ``verdict``: first, repeated (equal to the first), conflict or refused.

    ``refused`` tells events that end nothing, as a success that carries an
    error does; the first of the others counts.
    """
    rows = events.withColumn("_bad", F.coalesce(refused, F.lit(False)) if refused is not None else F.lit(False))
    ordered = Window.partitionBy(by, "_bad").orderBy(order)
    rows = rows.withColumns({"_first": F.first(F.struct(*value)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(ordered)})
    verdict = F.when(F.col("_bad"), "refused").when(F.col("_n") == 1, "first").when(F.struct(*value).eqNullSafe(F.col("_first")), "repeated").otherwise("conflict")
    return rows.withColumn("verdict", verdict).drop("_first", "_n", "_bad")


def run_states(begins: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Every run that began, with its end where there is one; failed ones stay visible."""
    return begins.join(ends, key, "left").withColumn("state", F.coalesce("state", F.lit("open")))


def completeness(expected: DataFrame, latest: DataFrame, by: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, expected, terminal, complete) of a campaign."""
    met = expected.join(latest, list(by), "left")
    done = F.count_if(F.coalesce(F.col("state").isin(*TERMINAL), F.lit(False)))
    return met.groupBy(*group).agg(F.count(F.lit(1)).alias("expected"), done.alias("terminal"), (done == F.count(F.lit(1))).alias("complete"))


def missing(required: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``required`` whose key ``present`` doesn't have; null keys are equal."""
    same = F.lit(True)
    for c in key:
        same &= required[c].eqNullSafe(present[c])
    return required.join(present, same, "left_anti")
