"""Queries of costs, metrics, trading rules, seals, evidence and trial artifacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import costs as C
from ..operators import rules as R
from . import views as V
from .registry import query
from .views import sql


def _rows(spark, sf):
    """Events as strategies' signals: a strategy is an event type, some returns and turnovers are missing."""
    e = V.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("strategy"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 != 0, (F.col("value") - 10) / 10000).alias("ret"), F.when(F.col("event_id") % 7 != 0, F.col("user_id") / 1000).alias("turnover"))


_ROWS = "(SELECT event_type AS strategy, event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN (value - 10) / 10000 END AS ret, CASE WHEN event_id % 7 <> 0 THEN user_id / 1000.0 END AS turnover FROM events)"
_ADJUSTED = f"""(SELECT strategy, bps, seq, t, coalesce(ret, 0) - CASE WHEN seq = max(seq) OVER (PARTITION BY strategy, bps) THEN sum(t) OVER (PARTITION BY strategy, bps) * bps / 10000 ELSE 0 END AS r
 FROM (SELECT *, coalesce(turnover, 1.0)::DOUBLE AS t FROM {_ROWS}) CROSS JOIN (VALUES (5.0::DOUBLE), (10.0::DOUBLE)) b(bps))"""
_METRICS = f"""(SELECT strategy, bps AS slippage_bps, count(*) AS signal_count, sum(r) AS total_return, CASE WHEN stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(count(*)) ELSE 0.0 END AS sharpe, sum(t) AS turnover,
 max(fall) AS max_drawdown FROM (SELECT *, (greatest(1.0, max(equity) OVER w) - equity) / greatest(1.0, max(equity) OVER w) AS fall FROM (SELECT *, product(1 + r) OVER (PARTITION BY strategy, bps ORDER BY seq) AS equity FROM {_ADJUSTED})
 WINDOW w AS (PARTITION BY strategy, bps ORDER BY seq)) GROUP BY ALL)"""
_R4 = "round(total_return, 4) AS total_return, round(sharpe, 4) AS sharpe, round(greatest(max_drawdown, 0.0), 4) AS max_drawdown, round(turnover, 4) AS turnover"


def _r4():
    return [F.round(c, 4).alias(c) for c in ("total_return", "sharpe", "max_drawdown", "turnover")]


@query(f"SELECT strategy, slippage_bps, signal_count, {_R4} FROM {_METRICS}")
def d9_strategy_metrics(spark, sf):
    return C.metrics(_rows(spark, sf), (5.0, 10.0)).select("strategy", "slippage_bps", "signal_count", *_r4())


@query(f"SELECT slippage_bps, sum(signal_count)::BIGINT AS signal_count, round(sum(total_return), 4) AS total_return, round(avg(sharpe), 4) AS sharpe, round(max(max_drawdown), 4) AS max_drawdown, round(sum(turnover), 4) AS turnover FROM {_METRICS} GROUP BY slippage_bps")
def d11_portfolio(spark, sf):
    return C.portfolio(C.metrics(_rows(spark, sf), (5.0, 10.0))).select("slippage_bps", "signal_count", *_r4())


@query(
    f"""SELECT bool_and(b.total_return <= a.total_return AND b.max_drawdown >= a.max_drawdown) AS monotone, count(*) AS compared
FROM (SELECT strategy, slippage_bps, total_return, max_drawdown FROM {_METRICS} UNION ALL SELECT 'aggregate', slippage_bps, sum(total_return), max(max_drawdown) FROM {_METRICS} GROUP BY slippage_bps) a
JOIN (SELECT strategy, slippage_bps, total_return, max_drawdown FROM {_METRICS} UNION ALL SELECT 'aggregate', slippage_bps, sum(total_return), max(max_drawdown) FROM {_METRICS} GROUP BY slippage_bps) b
ON a.strategy = b.strategy AND a.slippage_bps = 5 AND b.slippage_bps = 10"""
)
def d12_monotone_degradation(spark, sf):
    return C.degrades(C.metrics(_rows(spark, sf), (5.0, 10.0)), 5.0, 10.0)


@query(f"SELECT strategy, round(max(fall), 6) AS max_drawdown FROM (SELECT strategy, (greatest(1.0, max(equity) OVER w) - equity) / greatest(1.0, max(equity) OVER w) AS fall FROM (SELECT strategy, seq, product(1 + coalesce(ret, 0)) OVER (PARTITION BY strategy ORDER BY seq) AS equity FROM {_ROWS}) WINDOW w AS (PARTITION BY strategy ORDER BY seq)) GROUP BY strategy")
def d10_max_drawdown(spark, sf):
    rows = _rows(spark, sf).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return C.drawdowns(rows, ["strategy"], "seq").select("strategy", F.round("max_drawdown", 6).alias("max_drawdown"))


@query("SELECT user_id, event_id, round(product(1 + value / 10000) OVER w, 6) AS equity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def g15_equity_curve(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 10000).alias("ret"))
    return C.equity_curve(rows, ["user_id"], "event_id").select("user_id", "event_id", F.round("equity", 6).alias("equity"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, scenario, round(l_extendedprice - l_quantity * bps / 10000, 6) AS net FROM lineitem CROSS JOIN (VALUES ('c-free', 0.0::DOUBLE), ('c-stress2x', 30.0::DOUBLE)) s(scenario, bps)")
def i11_net_return(spark, sf):
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("gross"), F.col("l_quantity").alias("turnover"))
    return C.in_all_scenarios(rows).select("l_orderkey", "l_linenumber", "l_partkey", "scenario", F.round("net", 6).alias("net"))


@query("SELECT c_custkey, c_acctbal / 1e4 > 0 AND c_acctbal / 1e4 - 0.2 <= 0 AS only_free FROM customer")
def i13_only_free(spark, sf):
    free = F.col("c_acctbal") / 1e4
    return V.table(spark, sf, "customer").select("c_custkey", C.only_free(free, free - 0.2).alias("only_free"))


_STATE = "(SELECT c_custkey AS instrument_id, c_acctbal > 0 AS in_universe, c_custkey % 17 = 0 AS halted, c_custkey % 23 = 0 AS delisted FROM customer)"


@query(f"SELECT instrument_id, in_universe AND NOT halted AND NOT delisted AS tradable FROM {_STATE}")
def p6_tradable(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("instrument_id"), (F.col("c_acctbal") > 0).alias("in_universe"), (F.col("c_custkey") % 17 == 0).alias("halted"), (F.col("c_custkey") % 23 == 0).alias("delisted"))
    yes, no = R.tradable(c)
    return yes.select("instrument_id", F.lit(True).alias("tradable")).unionByName(no.select("instrument_id", F.lit(False).alias("tradable")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f = s THEN 'same_bar' WHEN f < s THEN 'before_signal' END AS reject_reason FROM (SELECT *, l_shipdate::DATE AS f, o_orderdate::DATE AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def p7_fill_legality(spark, sf):
    both = V.table(spark, sf, "lineitem").join(V.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", R.fill_fault(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("reject_reason"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' AND NOT coalesce(ok, false) THEN 'no_borrow' END AS fault
FROM lineitem LEFT JOIN (SELECT s_suppkey, bool_or(s_acctbal > 3000) AS ok FROM supplier GROUP BY ALL) ON l_suppkey = s_suppkey"""
)
def p8_borrow(spark, sf):
    orders = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("instrument_id"), F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"))
    borrow = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("instrument_id"), (F.col("s_acctbal") > 3000).alias("available"))
    return R.borrow_fault(orders, borrow).select("l_orderkey", "l_linenumber", "l_partkey", "fault")


_VETO = "CASE WHEN gross + abs(notional) > 1.0 + 1e-12 THEN 'gross_exposure' WHEN abs(net + CASE WHEN side = 'buy' THEN notional ELSE -notional END) > 0.5 + 1e-12 THEN 'net_exposure' WHEN loss > 0.1 + 1e-12 THEN 'loss_limit' END"


@query(sql(f"SELECT side, {_VETO} AS veto, count(*) AS n FROM intents GROUP BY ALL", "intents"))
def p14_risk_veto(spark, sf):
    v = R.veto(*(F.col(c) for c in ("notional", "side", "gross", "net", "loss")))
    return V.intents(spark, sf).groupBy("side", v.alias("veto")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, contains(lower(text), 'ignore risk') OR contains(lower(text), 'override limit') OR contains(lower(text), 'disable veto') OR contains(lower(text), 'increase max_gross') AS asks FROM conversations WHERE text IS NOT NULL")
def p15_override_phrases(spark, sf):
    return V.table(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", R.asks_override(F.col("text")).alias("asks"))


@query("SELECT doc_id, quality - toxic * 0.4 - toxic * 0.2 > 0.5 AS flagged FROM labels")
def p10_contamination(spark, sf):
    return V.table(spark, sf, "labels").select("doc_id", R.contaminated(F.col("quality") - F.col("toxic") * 0.4, F.col("toxic") * 0.2).alias("flagged"))


@query("SELECT o_orderkey, d AS local_date, d AS utc_date, CASE WHEN d IS NOT NULL THEN 'UTC' END AS zone FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)")
def p16_daily_stamp(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate").cast("string")).otherwise(F.to_date("o_orderdate").cast("string").substr(1, 7))
    return V.table(spark, sf, "orders").select("o_orderkey", R.daily_stamp(text).alias("s")).select("o_orderkey", "s.local_date", "s.utc_date", "s.zone")


_ARTIFACT = """(SELECT doc_id, sha256(doc_id::VARCHAR) AS h, CASE WHEN doc_id % 3 = 0 THEN 'short' WHEN doc_id % 5 = 0 THEN '' ELSE sha256('x' || doc_id) END AS code_sha, CASE WHEN doc_id % 7 = 0 THEN 'running' ELSE 'success' END AS status,
 doc_id % 11 = 0 AS no_seeds, quality AS sealed, toxic AS unsealed FROM labels)"""


@query(
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN code_sha = '' THEN 'code_sha: none' END, CASE WHEN code_sha = 'short' THEN 'code_sha: not 64 hex digits' END, CASE WHEN no_seeds THEN 'seeds: none' END,
 CASE WHEN status = 'running' THEN 'status: not an end' END, CASE WHEN code_sha IN ('', 'short') THEN 'artifact code: not 64 hex digits' END, CASE WHEN sealed - unsealed > 0.5 THEN 'scores: sealed far above unsealed' END],
 lambda x: x IS NOT NULL), '; ') AS violations FROM {_ARTIFACT}"""
)
def p9_trial_gate(spark, sf):
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    doc = F.col("doc_id")
    code = F.when(doc % 3 == 0, "short").when(doc % 5 == 0, "").otherwise(sha(F.concat(F.lit("x"), doc.cast("string"))))
    a = V.table(spark, sf, "labels").withColumns(
        {**{n: sha(doc) for n in R.HASHES}, "run_id": doc.cast("string"), "experiment_id": F.lit("e"), "split_policy_ref": F.lit("s"), "cost_model_ref": F.lit("c"), "agent_origin": F.lit("a")}
    )
    a = a.withColumns(
        {
            "code_sha": code, "status": F.when(doc % 7 == 0, "running").otherwise("success"), "seeds": F.when(doc % 11 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))),
            "artifacts": F.create_map(F.lit("code"), code), "metrics": F.create_map(F.lit("sealed_score"), F.col("quality").cast("double"), F.lit("unsealed_score"), F.col("toxic").cast("double")),
        }
    )
    return R.gate(a).select("doc_id", F.array_join("violations", "; ").alias("violations"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN event_type IN ('view', 'error') THEN 'entity_type' END, CASE WHEN event_id % 3 = 0 THEN 'activity_type' END, CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'decided_by' END], lambda x: x IS NOT NULL), ',') AS faults FROM events")
def p11_evidence_ontology(spark, sf):
    names = F.create_map(*map(F.lit, ("click", "FactorVersion", "purchase", "ExperimentRun", "signup", "PromotionReview", "view", "Note", "error", "Note")))
    e = V.table(spark, sf, "events").select("event_id", F.element_at(names, F.col("event_type")).alias("entity"), F.when(F.col("event_id") % 3 == 0, "guess").otherwise("train").alias("activity"), F.to_date("ts").alias("known_at"), F.when(F.col("event_id") % 2 == 1, "someone").alias("by"))
    faults = R.evidence_faults(F.col("entity"), F.col("activity"), ("ingest", "train", "evaluate", "review", "promote"), F.col("event_id").cast("string"), F.col("known_at"), F.col("by"))
    return e.select("event_id", F.array_join(faults, ",").alias("faults"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'length' END, CASE WHEN doc_id % 4 = 0 THEN 'hex' END, CASE WHEN doc_id % 9 = 0 THEN 'epoch' END, CASE WHEN doc_id % 6 = 0 THEN 'count' END, CASE WHEN doc_id % 4 = 0 THEN 'mismatch' END], lambda x: x IS NOT NULL), ',') AS faults FROM labels")
def p12_seal_structure(spark, sf):
    root = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    given = F.when(F.col("doc_id") % 4 == 0, "short").otherwise(root)
    faults = R.seal_faults(given, root, F.col("doc_id") % 9, F.col("doc_id") % 6)
    return V.table(spark, sf, "labels").select("doc_id", F.array_join(faults, ",").alias("faults"))


@query("SELECT event_id, event_id % 4 BETWEEN 1 AND 2 AS allowed FROM events")
def p13_use_counter(spark, sf):
    return V.table(spark, sf, "events").select("event_id", R.within_uses(F.col("event_id") % 4, F.lit(2)).alias("allowed"))


@query("SELECT event_id, observed, CASE WHEN t = 'SEAL-A' THEN observed <= 2 ELSE observed = 1 END AS within_quota FROM (SELECT event_id, t, sum(1) OVER (PARTITION BY user_id, t ORDER BY event_id)::BIGINT AS observed FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'SEAL-A' ELSE 'SEAL-B' END AS t FROM events))")
def g9_seal_quota(spark, sf):
    seals = V.table(spark, sf, "events").select("event_id", F.col("user_id").alias("epoch"), F.when(F.col("event_type") == "view", "SEAL-A").otherwise("SEAL-B").alias("seal_type"), F.lit(1).alias("count_in_epoch"))
    return R.seal_quota(seals, "event_id").select("event_id", "observed", "within_quota")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN source = 'src3' THEN 'code_sha' END, CASE WHEN lang = 'de' THEN 'cost_model_ref' END, CASE WHEN n_chars < 300 THEN 'seeds' END], lambda x: x IS NOT NULL), ',') AS faults FROM documents")
def p23_spec_completeness(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.when(F.col("source") != "src3", "h").alias("code_sha"), F.when(F.col("lang") == "de", "").otherwise("c").alias("cost_model_ref"), F.when(F.col("n_chars") < 300, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("seeds"))
    return d.select("doc_id", F.array_join(R.spec_faults(d), ",").alias("faults"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN e < s THEN 'times' END, CASE WHEN l_returnflag = 'A' AND l_tax > 0.05 THEN 'error_on_success' END, CASE WHEN l_returnflag = 'R' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS faults
FROM (SELECT *, o_orderdate AS s, l_shipdate AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
)
def p22_receipt_validity(spark, sf):
    both = V.table(spark, sf, "lineitem").join(V.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.element_at(F.create_map(*map(F.lit, ("A", "completed", "N", "failed", "R", "lost"))), F.col("l_returnflag"))
    faults = R.receipt_faults(status, F.col("o_orderdate"), F.col("l_shipdate"), F.when(F.col("l_tax") > 0.05, "e"), F.col("l_linenumber"), ("completed", "failed"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(faults, ",").alias("faults"))


@query(sql("SELECT instrument_id, vt, round(CASE WHEN n3 >= 3 THEN m3 END, 6) AS mean3, round(CASE WHEN ne >= 3 THEN me END, 6) AS expanding, first AS first_close FROM (SELECT *, count(*) OVER a AS n3, avg(close) OVER a AS m3, count(*) OVER b AS ne, avg(close) OVER b AS me, first_value(close) OVER b AS first FROM bars WINDOW a AS (PARTITION BY instrument_id ORDER BY vt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument_id ORDER BY vt ROWS UNBOUNDED PRECEDING))", "bars"))
def g1_g2_g5_windows(spark, sf):
    w = Window.partitionBy("instrument_id").orderBy("vt")
    three, so_far = w.rowsBetween(-2, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    guarded = lambda frame: F.round(F.when(F.count("close").over(frame) >= 3, F.avg("close").over(frame)), 6)
    return V.bars(spark, sf).select("instrument_id", "vt", guarded(three).alias("mean3"), guarded(so_far).alias("expanding"), F.first("close").over(so_far).alias("first_close"))


@query(sql("SELECT vt, instrument_id, round((rank() OVER (PARTITION BY vt ORDER BY close) + (count(*) OVER (PARTITION BY vt, close) - 1) / 2.0) / count(*) OVER (PARTITION BY vt), 6)::DOUBLE AS pct, row_number() OVER (PARTITION BY vt ORDER BY close, instrument_id) AS ordinal FROM bars", "bars"))
def g4_g6_ranks(spark, sf):
    from ..operators.labels import average_rank, ordinal_rank

    pct = average_rank(["vt"], "close") / F.count(F.lit(1)).over(Window.partitionBy("vt"))
    return V.bars(spark, sf).select("vt", "instrument_id", F.round(pct, 6).alias("pct"), ordinal_rank(["vt"], "close").cast("bigint").alias("ordinal"))
