"""Rules of trading, risk, seals, evidence and trial artifacts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rules.
MAX_GROSS, MAX_NET, MAX_LOSS, TOLERANCE = 1.0, 0.5, 0.1, 1e-12
OVERRIDES = ("ignore risk", "override limit", "disable veto", "increase max_gross")
REQUIRED = (
    "run_id", "experiment_id", "dataset_manifest_hash", "feature_ir_hash", "model_config_hash", "code_sha", "env_lock_hash",
    "seeds", "split_policy_ref", "cost_model_ref", "agent_origin", "status", "artifacts", "metrics",
)
HASHES = ("dataset_manifest_hash", "feature_ir_hash", "model_config_hash", "code_sha", "env_lock_hash")
ENTITIES = ("FactorVersion", "DatasetSnapshot", "ExperimentRun", "ModelArtifact", "PromotionReview")
SPEC_FIELDS = ("experiment_id", "dataset_manifest_hash", "feature_ir_hash", "model_config_hash", "code_sha", "env_lock_hash", "split_policy_ref", "cost_model_ref")


def hex64(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit("^[0-9a-fA-F]{64}$")), F.lit(False))


def tradable(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tradable, rejected) instruments; a state that isn't known counts as against."""
    ok = F.coalesce(F.col("in_universe"), F.lit(False)) & ~F.coalesce(F.col("halted"), F.lit(True)) & ~F.coalesce(F.col("delisted"), F.lit(True))
    return state.filter(ok), state.filter(~ok)


def fill_fault(signal_bar: Column, fill_bar: Column) -> Column:
    """Why a fill is illegal: on the bar of its signal, or before it; null if it is legal."""
    return F.when(fill_bar == signal_bar, "same_bar").when(fill_bar < signal_bar, "before_signal")


def borrow_fault(orders: DataFrame, borrow: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Orders with ``fault``: sells need an available borrow."""
    known = borrow.select(key, "available").groupBy(key).agg(F.bool_or("available").alias("_available"))
    met = orders.join(known, key, "left")
    return met.withColumn("fault", F.when((F.col("side") == "sell") & ~F.coalesce("_available", F.lit(False)), "no_borrow")).drop("_available")


def veto(notional: Column, side: Column, gross: Column, net: Column, loss: Column, max_gross=MAX_GROSS, max_net=MAX_NET, max_loss=MAX_LOSS) -> Column:
    """The first limit that an order breaks: gross, then net exposure, then loss; null if none."""
    signed = F.when(side == "buy", notional).otherwise(-notional)
    return (
        F.when(gross + F.abs(notional) > F.lit(max_gross) + TOLERANCE, "gross_exposure")
        .when(F.abs(net + signed) > F.lit(max_net) + TOLERANCE, "net_exposure")
        .when(loss > F.lit(max_loss) + TOLERANCE, "loss_limit")
    )


def asks_override(text: Column) -> Column:
    """Whether an instruction asks to widen the limits; it never does."""
    return F.coalesce(F.exists(F.array(*map(F.lit, OVERRIDES)), lambda p: F.lower(text).contains(p)), F.lit(False))


def contaminated(sealed: Column, unsealed: Column) -> Column:
    return F.coalesce(sealed - unsealed > 0.5, F.lit(False))


def daily_stamp(day: Column, zone: str = "UTC") -> Column:
    """(local_date, utc_date, zone) of a YYYY-MM-DD text, null for any other; the dates are the same by contract."""
    good = F.regexp_like(day, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    return F.when(good, F.struct(day.alias("local_date"), day.alias("utc_date"), F.lit(zone).alias("zone")))


def gate(artifacts: DataFrame) -> DataFrame:
    """Trial artifacts with all their ``violations``.

    Columns are those of REQUIRED (seeds an array, artifacts and metrics maps);
    a column that isn't there is a missing field of every row.
    """
    have = set(artifacts.columns)
    get = lambda n, t="string": F.col(n) if n in have else F.lit(None).cast(t)
    say = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.array(text if isinstance(text, Column) else F.lit(text))).otherwise(F.array().cast("array<string>"))
    missing = F.array_compact(F.array(*(F.when(get(n).isNull(), F.lit(n)) for n in sorted(REQUIRED))))
    parts = [say(F.size(missing) > 0, F.concat(F.lit("not there: "), F.concat_ws("+", missing)))]
    for n in HASHES:
        own = get(n)
        empty = own.isNull() | (own == "")
        parts += [say(empty, f"{n}: none"), say(~empty & ~hex64(own), f"{n}: not 64 hex digits")]
    seeds, status = get("seeds", "array<int>"), get("status")
    parts.append(say(seeds.isNull() | (F.size(seeds) == 0), "seeds: none"))
    parts.append(say(status.isNull() | ~status.isin("success", "failed", "invalid"), "status: not an end"))
    bad = F.map_keys(F.map_filter(get("artifacts", "map<string,string>"), lambda k, v: ~hex64(v)))
    parts.append(F.coalesce(F.transform(F.array_sort(bad), lambda k: F.concat(F.lit("artifact "), k, F.lit(": not 64 hex digits"))), F.array().cast("array<string>")))
    feature = F.lower(get("feature_ir_hash"))
    parts.append(say(feature.contains("label") | feature.contains("target"), "feature_ir_hash: names a label or target"))
    scores = get("metrics", "map<string,double>")
    skipped = F.coalesce(get("skipped_contamination_check", "boolean"), F.lit(False))
    parts.append(say(~skipped & contaminated(F.try_element_at(scores, F.lit("sealed_score")), F.try_element_at(scores, F.lit("unsealed_score"))), "scores: sealed far above unsealed"))
    return artifacts.withColumn("violations", F.concat(*parts))


def evidence_faults(entity: Column, activity: Column, activities: Sequence[str], entity_hash: Column, known_at: Column, decided_by: Column) -> Column:
    say = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), F.lit(text))
    return F.array_compact(
        F.array(
            say(~entity.isin(*ENTITIES), "entity_type"), say(~activity.isin(*activities), "activity_type"),
            say((entity_hash == "") | entity_hash.isNull(), "entity_hash"), say(known_at.isNull(), "known_at"),
            say((entity == "PromotionReview") & (decided_by.isNull() | (decided_by == "")), "decided_by"),
        )
    )


def seal_faults(root: Column, given_root: Column, epoch: Column, count: Column) -> Column:
    say = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), F.lit(text))
    return F.array_compact(F.array(say(F.length(root) != 64, "length"), say(~hex64(root), "hex"), say(epoch < 1, "epoch"), say(count < 1, "count"), say(root != given_root, "mismatch")))


def within_uses(use: Column, most: Column) -> Column:
    return use.between(F.lit(1), most)


def seal_quota(seals: DataFrame, order: str = "seq") -> DataFrame:
    """Seals with the running count of their epoch and type, and whether it keeps the quota: two of SEAL-A, one of SEAL-B."""
    so_far = Window.partitionBy("epoch", "seal_type").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = seals.withColumn("observed", F.sum("count_in_epoch").over(so_far))
    return out.withColumn("within_quota", F.when(F.col("seal_type") == "SEAL-A", F.col("observed") <= 2).when(F.col("seal_type") == "SEAL-B", F.col("observed") == 1).otherwise(False))


def spec_faults(rows: DataFrame, fields: Sequence[str] = SPEC_FIELDS) -> Column:
    """Fields of a run's spec that are empty; ``seeds`` needs at least one."""
    empty = [F.when(F.coalesce(F.col(f) == "", F.lit(True)), F.lit(f)) for f in fields if f in rows.columns]
    if "seeds" in rows.columns:
        empty.append(F.when(F.coalesce(F.size("seeds") == 0, F.lit(True)), F.lit("seeds")))
    return F.array_compact(F.array(*empty))


def receipt_faults(status: Column, started: Column, ended: Column, error: Column, retry: Column, statuses: Sequence[str]) -> Column:
    say = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.lit(text))
    return F.array_compact(
        F.array(
            say(ended < started, "times"), say((status == "completed") & error.isNotNull(), "error_on_success"),
            say(retry.isNull() | (retry < 0), "retry_seq"), say(status.isNull() | ~status.isin(*statuses), "status"),
        )
    )
