"""What runs and receipts say of themselves: artifacts, evidence and the part of a receipt that doesn't change from run to run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pins import group_fingerprint, stable_id
from .rules import HASHES

RECEIPT = "work_order_hash string, terminal_status string, metrics array<struct<name:string,value:double>>, artifact_manifest array<struct<path:string,sha256:string>>"


def trial_artifact(runs: DataFrame, name: str = "artifact") -> DataFrame:
    """``runs`` with the artifact of each: its ids, hashes, policies, status, artifacts and metrics as JSON."""
    fields = ["run_id", "experiment_id", *HASHES, "seeds", "split_policy_ref", "cost_model_ref", "agent_origin", "status", "artifacts", "metrics"]
    return runs.withColumn(name, F.to_json(F.struct(*(F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in fields)), {"ignoreNullFields": "false"}))


def evidence_commit(runs: DataFrame, known_at: Column, activity: str = "ExperimentRun", snapshot: str = "snapshot_hash", decided_by: Column | None = None) -> DataFrame:
    """(entity_type, entity_hash, activity_type, known_at, derived_from, decided_by, hash) of each run: what it was made from, and since when it is known."""
    made = runs.select(
        F.lit("RunRecord").alias("entity_type"), F.col("run_id").alias("entity_hash"), F.lit(activity).alias("activity_type"), known_at.cast("string").alias("known_at"),
        F.array(F.col(snapshot), F.col("feature_ir_hash")).alias("derived_from"), (F.lit(None).cast("string") if decided_by is None else decided_by).alias("decided_by"),
    )
    return made.withColumn("hash", stable_id(*made.columns))


def evidence_reference(runs: DataFrame, snapshot: str = "snapshot_hash", kind: str = "evidence_reference") -> DataFrame:
    """(type, run_id, snapshot_hash): the short form that runs and receipts carry."""
    return runs.select(F.lit(kind).alias("type"), "run_id", F.col(snapshot).alias("snapshot_hash"))


def evidence_payload(commits: DataFrame, kind: str = "evidence") -> DataFrame:
    """Commits as they are handed to review: their fields with a type."""
    return commits.select(F.lit(kind).alias("type"), *commits.columns)


def receipt_projection(receipts: DataFrame, column: str = "receipt") -> DataFrame:
    """``receipts`` (JSON) as (work_order_hash, terminal_status, metrics, artifact_sha256), without clocks, workers and paths; hashes are sorted."""
    r = receipts.select(*(c for c in receipts.columns if c != column), F.from_json(column, RECEIPT).alias("_r"))
    kept = [c for c in r.columns if c != "_r"]
    hashes = F.array_sort(F.transform(F.coalesce("_r.artifact_manifest", F.array().cast("array<struct<path:string,sha256:string>>")), lambda a: a["sha256"]))
    metrics = F.array_sort(F.coalesce("_r.metrics", F.array().cast("array<struct<name:string,value:double>>")))
    return r.select(*kept, "_r.work_order_hash", "_r.terminal_status", metrics.alias("metrics"), hashes.alias("artifact_sha256"))


def campaign_fingerprint(projections: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, fingerprint) of campaigns' projected receipts, in any order."""
    return group_fingerprint(projections, by, ["work_order_hash", "terminal_status", "metrics", "artifact_sha256"])


def canonical_order(grid: DataFrame, dimensions: Sequence[str], last: str = "task_type", place: str = "place") -> DataFrame:
    """A grid's rows with their place in the order of all dimensions, a missing one first, then ``last``.

    Grids are the product of lists that somebody wrote down, thousands of rows,
    so one sort numbers them.
    """
    order = [F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dimensions] + [F.col(last)]
    return grid.withColumn(place, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
