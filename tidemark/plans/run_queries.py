"""Queries over logs of attempts and runs, content hashes, campaign grids, sets and landed files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitemporal as B
from ..operators import pins as K
from ..operators import projections as P
from ..operators import runlog as G
from ..operators import search as S
from ..operators.pin_store import PinStore
from ..operators.ranks import placed
from ..sources import ingest as I
from . import views as V
from .folders import new_folder as _folder
from .folders import written
from .registry import query
from .views import sql


def _print_sql(rows: str, by: str) -> str:
    """Fingerprints of groups: digests in order by their first three digits, then those of the parts."""
    part = f"SELECT {by}, substr(d, 1, 3) AS b, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM ({rows}) GROUP BY ALL"
    return f"SELECT {by}, sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY b)) AS fingerprint FROM ({part}) GROUP BY {by}"


_LATEST = "(SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY work_order ORDER BY retry_seq DESC, seq DESC) = 1)"


@query(sql(f"SELECT work_order, retry_seq, state, event_id FROM {_LATEST}", "attempts"))
def g7_latest_attempt(spark, sf):
    return G.latest_state(V.attempts(spark, sf), ["work_order"], F.desc("retry_seq"), F.desc("seq")).select("work_order", "retry_seq", "state", "event_id")


@query(sql("SELECT work_order, max(retry_seq) + 1 AS next_retry FROM attempts GROUP BY work_order", "attempts"))
def g8_next_retry(spark, sf):
    return G.next_retry(V.attempts(spark, sf))


def _moves_sql(moves: dict, first: str) -> str:
    ok = " OR ".join(f"(p = '{s}' AND state IN ({', '.join(repr(x) for x in after)}))" for s, after in moves.items())
    return f"CASE WHEN p IS NULL THEN state <> '{first}' ELSE NOT ({ok}) END"


@query(sql(f"SELECT work_order, retry_seq, state, event_id, p AS previous FROM (SELECT *, lag(state) OVER (PARTITION BY work_order, retry_seq ORDER BY seq) AS p FROM attempts) WHERE {_moves_sql(G.ATTEMPT_MOVES, 'issued')}", "attempts"))
def g10_transition_audit(spark, sf):
    return G.illegal_moves(V.attempts(spark, sf), ["work_order", "retry_seq"], "seq", G.ATTEMPT_MOVES, "issued").select("work_order", "retry_seq", "state", "event_id", "previous")


_LADDER = {"issued": "IDLE", "queued": "SEALED", "running": "RUNNING", "completed": "SCORED", "failed": "REJECTED"}


@query(sql(f"SELECT work_order, event_id, state, p AS previous FROM (SELECT *, lag(state) OVER (PARTITION BY work_order ORDER BY seq) AS p FROM (SELECT work_order, event_id, seq, CASE state {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in _LADDER.items())} END AS state FROM attempts)) WHERE {_moves_sql(G.LADDER_MOVES, 'IDLE')}", "attempts"))
def g10_promotion_ladder(spark, sf):
    ladder = F.element_at(F.create_map(*(F.lit(x) for pair in _LADDER.items() for x in pair)), F.col("state"))
    return G.illegal_moves(V.attempts(spark, sf).withColumn("state", ladder), ["work_order"], "seq", G.LADDER_MOVES, "IDLE").select("work_order", "event_id", "state", "previous")


@query(sql("SELECT work_order, event_id, CASE WHEN r = 0 THEN 'before_review' ELSE 'duplicate' END AS fault FROM (SELECT *, sum((state = 'running')::INT) OVER w AS r, sum((state = 'completed')::INT) OVER w AS a FROM attempts WINDOW w AS (PARTITION BY work_order ORDER BY seq)) WHERE state = 'completed' AND (r = 0 OR a > 1)", "attempts"))
def g11_authority(spark, sf):
    log = V.attempts(spark, sf).withColumn("event", F.when(F.col("state") == "running", "review").when(F.col("state") == "completed", "approve"))
    return G.authority_faults(log.filter("event is not null"), "work_order").select("work_order", "event_id", "fault")


@query(sql("SELECT namespace, instrument_id, vt, revision, row_number() OVER (PARTITION BY namespace ORDER BY kt, instrument_id, vt, revision) AS place FROM records", "records"))
def g12_output_order(spark, sf):
    return placed(V.records(spark, sf), ["kt", "instrument_id", "vt", "revision"], ["namespace"]).select(*B.KEY, "revision", "place")


@query("SELECT event_type AS lane, max(value) AS best, arg_max(event_id, (value, -event_id)) AS best_trial FROM events GROUP BY event_type")
def g14_best_of_lane(spark, sf):
    return V.table(spark, sf, "events").groupBy(F.col("event_type").alias("lane")).agg(F.max("value").alias("best"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_trial"))


@query("SELECT user_id AS work_order, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 20) GROUP BY user_id")
def h5_insert_or_ignore(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("work_order"), "event_id", "event_type", "value")
    have = e.filter("event_type = 'signup' and value > 20").select("work_order").distinct()
    return G.insert_missing(have, e.filter("event_type = 'click'"), ["work_order"], F.col("event_id")).select("work_order", "event_id")


_RECEIPTS = """(SELECT a.*, coalesce((SELECT arg_max(x.state, x.seq) FROM attempts x WHERE x.work_order = a.work_order AND x.retry_seq = a.retry_seq AND x.seq < a.seq) = 'running', false) AS running FROM attempts a WHERE state IN ('completed', 'failed'))"""


@query(sql(f"SELECT work_order, event_id, CASE WHEN NOT running THEN 'invalid' WHEN state = 'completed' AND k = 1 THEN 'committed' WHEN state = 'completed' THEN 'superseded_duplicate' ELSE 'ended' END AS outcome FROM (SELECT *, sum((running AND state = 'completed')::INT) OVER (PARTITION BY work_order ORDER BY seq) AS k FROM {_RECEIPTS})", "attempts"))
def h6_receipt_outcomes(spark, sf):
    return G.receipt_outcomes(V.attempts(spark, sf)).select("work_order", "event_id", "outcome")


@query("SELECT o_custkey AS idempotency_key, o_orderkey AS run_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def h7_idempotent_begin(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("idempotency_key"), F.col("o_orderkey").alias("run_id"))
    return G.begin_once(o, order="run_id")


_BAD_END = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"


@query(f"SELECT o_orderkey, 'refused' AS verdict FROM orders WHERE {_BAD_END} UNION ALL SELECT o_orderkey, CASE WHEN n = 1 THEN 'first' WHEN o_orderstatus = f THEN 'repeated' ELSE 'conflict' END FROM (SELECT *, row_number() OVER w AS n, first_value(o_orderstatus) OVER w AS f FROM orders WHERE NOT ({_BAD_END}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))")
def h8_first_finalize(spark, sf):
    """Orders as ends of their customers' runs: F is a success, and an urgent order carries an error."""
    return G.finalize_conflicts(V.table(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus"], F.expr(_BAD_END)).select("o_orderkey", "verdict")


@query("SELECT c_custkey AS run, coalesce(s, 'open') AS state FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS s FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey) ON c_custkey = o_custkey")
def h9_visible_runs(spark, sf):
    ends = V.table(spark, sf, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("run")).agg(F.max("o_orderstatus").alias("state"))
    return G.run_states(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("run")), ends, "run")


@query("SELECT event_type AS x FROM events UNION ALL SELECT o_orderpriority FROM orders")
def h1_union(spark, sf):
    a = V.table(spark, sf, "events").select(F.col("event_type").alias("x"))
    return a.unionByName(V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("x")))


@query("SELECT user_id AS instrument FROM events INTERSECT SELECT l_suppkey FROM lineitem")
def h2_intersection(spark, sf):
    return V.table(spark, sf, "events").select(F.col("user_id").alias("instrument")).intersect(V.table(spark, sf, "lineitem").select("l_suppkey"))


@query("SELECT user_id AS instrument FROM events EXCEPT SELECT l_suppkey FROM lineitem")
def h3_missing(spark, sf):
    return G.missing(V.table(spark, sf, "events").select(F.col("user_id").alias("instrument")).distinct(), V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("instrument")), ["instrument"])


@query("SELECT DISTINCT source, lang FROM documents")
def h4_distinct_dimensions(spark, sf):
    return V.table(spark, sf, "documents").select("source", "lang").dropDuplicates()


@query("SELECT a.source AS fold, b.lang AS seed, sha256(a.source || '/' || b.lang) AS row_id FROM (SELECT DISTINCT source FROM documents) a CROSS JOIN (SELECT DISTINCT lang FROM documents) b")
def c7_campaign_grid(spark, sf):
    """The product of two dimensions of the data: the distinct values of one, few as they are, are broadcast to the other's."""
    d = V.table(spark, sf, "documents")
    seeds = d.agg(F.collect_set("lang").alias("seeds"))
    rows = d.select(F.col("source").alias("fold")).distinct().crossJoin(F.broadcast(seeds)).select("fold", F.explode("seeds").alias("seed"))
    return rows.withColumn("row_id", F.sha2(F.concat_ws("/", "fold", "seed"), 256))


@query("SELECT 0::BIGINT AS only_a, count(*) AS only_b FROM orders WHERE o_orderstatus = 'P'")
def c8_parity(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return K.parity(o.filter("o_orderstatus <> 'P'"), o)


@query(sql(f"SELECT campaign, count(*) AS expected, count(*) FILTER (state IN ('completed', 'failed')) AS terminal, count(*) FILTER (state IN ('completed', 'failed')) = count(*) AS complete FROM (SELECT c_custkey AS work_order, c_mktsegment AS campaign FROM customer) e LEFT JOIN {_LATEST} USING (work_order) GROUP BY campaign", "attempts"))
def c9_d14_completeness(spark, sf):
    expected = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("work_order"), F.col("c_mktsegment").alias("campaign"))
    latest = G.latest_state(V.attempts(spark, sf), ["work_order"], F.desc("retry_seq"), F.desc("seq"))
    return G.completeness(expected, latest, ["work_order"], ["campaign"])


@query("SELECT o_custkey AS epoch, o_orderkey, coalesce(n, 0) AS registered FROM orders LEFT JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c = o_custkey")
def c13_seal_registry(spark, sf):
    o = V.table(spark, sf, "orders")
    registry = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return o.join(registry, "o_custkey", "left").select(F.col("o_custkey").alias("epoch"), "o_orderkey", F.coalesce("n", F.lit(0)).alias("registered"))


@query("SELECT l_orderkey AS key, count(DISTINCT l_returnflag) AS n_digests, count(DISTINCT l_linenumber) AS n_seen FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linenumber) <> (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def d18_determinism(spark, sf):
    """Line numbers as runs and orders as keys: orders whose flags differ between runs, or that a run lacks."""
    runs = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("run"), F.sha2("l_returnflag", 256).alias("digest"))
    return K.unstable_keys(runs, ["key"], "digest").select("key", "n_digests", "n_seen")


_D19_PRINTS = _print_sql("SELECT work_order % 10 AS campaign, sha256('{\"event_id\":' || event_id || ',\"work_order\":' || work_order || '}') AS d FROM outcomes WHERE outcome = 'committed'", "campaign")


@query(
    sql(
        f"""SELECT * FROM (WITH outcomes AS (SELECT work_order, event_id, CASE WHEN NOT running THEN 'invalid' WHEN state = 'completed' AND k = 1 THEN 'committed' WHEN state = 'completed' THEN 'superseded_duplicate' ELSE 'ended' END AS outcome
 FROM (SELECT *, sum((running AND state = 'completed')::INT) OVER (PARTITION BY work_order ORDER BY seq) AS k FROM {_RECEIPTS})),
status AS (SELECT work_order % 10 AS campaign, count(*) AS expected, count(*) FILTER (state IN ('completed', 'failed')) AS terminal FROM {_LATEST} GROUP BY 1),
counts AS (SELECT work_order % 10 AS campaign, count(*) FILTER (outcome = 'committed') AS n_authoritative, count(*) FILTER (outcome = 'superseded_duplicate') AS duplicates FROM outcomes GROUP BY 1)
SELECT s.campaign, expected, terminal, terminal = expected AS complete, n_authoritative, duplicates, CASE WHEN terminal = expected THEN fingerprint END AS fingerprint
FROM status s LEFT JOIN counts USING (campaign) LEFT JOIN ({_D19_PRINTS}) p USING (campaign))""",
        "attempts",
    )
)
def d19_complete_only(spark, sf):
    """Per campaign: authoritative and duplicate receipts, and a fingerprint only where every attempt has ended."""
    log = V.attempts(spark, sf)
    found = G.receipt_outcomes(log).withColumn("campaign", F.col("work_order") % 10)
    expected = log.select("work_order").distinct().withColumn("campaign", F.col("work_order") % 10)
    status = G.completeness(expected, G.latest_state(log, ["work_order"], F.desc("retry_seq"), F.desc("seq")), ["work_order"], ["campaign"])
    counts = found.groupBy("campaign").agg(F.count_if(F.col("outcome") == "committed").alias("n_authoritative"), F.count_if(F.col("outcome") == "superseded_duplicate").alias("duplicates"))
    prints = K.group_fingerprint(found.filter("outcome = 'committed'"), ["campaign"], ["work_order", "event_id"]).select("campaign", "fingerprint")
    return status.join(counts, "campaign", "left").join(prints, "campaign", "left").withColumn("fingerprint", F.when(F.col("complete"), F.col("fingerprint")))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def k1_record_digest(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


_RECORD = """sha256('{"instrument_id":' || instrument_id || ',"kt":"' || kt || '","namespace":"' || namespace || '","revision":' || revision || ',"value":' || value || ',"vt":"' || vt || '"}')"""
_PIN = f"""(SELECT sha256(string_agg(d, '' ORDER BY b)) AS pin, sum(n)::BIGINT AS n FROM (SELECT substr(b, 1, 2) AS b, sha256(string_agg(d, '' ORDER BY b)) AS d, sum(n) AS n
 FROM (SELECT substr(d, 1, 5) AS b, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM (SELECT {_RECORD} AS d FROM records) GROUP BY 1) GROUP BY 1))"""


@query(sql(f"SELECT pin, n, unnest(['as read', 'dealt anew']) AS \"order\" FROM {_PIN}", "records"))
def k2_snapshot_pin(spark, sf):
    """The pin of all records, and that of the same rows in another order."""
    r = V.records(spark, sf)
    return K.snapshot_pin(r).withColumn("order", F.lit("as read")).unionByName(K.snapshot_pin(r.repartition(F.xxhash64("value", "vt"))).withColumn("order", F.lit("dealt anew")))


_PINNED = ("2024-01-08", "2024-01-12", "9999-12-31")


def _pinned_sql(k: int, until: str) -> str:
    known = _PIN.replace("FROM records)", f"FROM records WHERE kt <= DATE '{until}')")
    return f"SELECT {k}::BIGINT AS batch, pin, n, pin AS fresh FROM {known}"


@query(sql(" UNION ALL ".join(_pinned_sql(k, until) for k, until in enumerate(_PINNED)), "records"))
def k2_pin_store(spark, sf):
    """Pins of a store after each of three appends by knowledge time, beside fresh pins of all that is known by then."""
    folder = _folder(spark)
    store = PinStore(spark, f"pins_{folder.rsplit('-', 1)[-1].replace('/', '_')}", path=folder)
    r, since, found = V.records(spark, sf), "0001-01-01", None
    for k, until in enumerate(_PINNED):
        known = F.col("kt") <= F.lit(until).cast("date")
        store.append(r.filter(known & (F.col("kt") > F.lit(since).cast("date"))), k)
        since, batch = until, F.lit(k).cast("bigint").alias("batch")
        fresh = K.snapshot_pin(r.filter(known)).select(batch, F.col("pin").alias("fresh"))
        both = store.pin(k).withColumn("batch", batch).join(F.broadcast(fresh), "batch").select("batch", "pin", "n", "fresh")  # a row each
        found = both if found is None else found.unionByName(both)
    found = written(found, "pins")
    store.drop()
    return found


@query(sql(f"SELECT 'records' AS manifest_id, pin, n, first, last, n_instruments, true AS matches FROM {_PIN}, (SELECT min(vt) AS first, max(vt) AS last, count(DISTINCT instrument_id) AS n_instruments FROM records)", "records"))
def k3_manifest(spark, sf):
    """A manifest of all records, verified against them."""
    r = V.records(spark, sf)
    return K.verify(r, K.manifest(r, "records"))


@query("""WITH RECURSIVE t(h) AS (SELECT list(x ORDER BY x) FROM (SELECT sha256(o_orderkey::VARCHAR) AS x FROM orders)
UNION ALL SELECT list_transform(range(0, (len(h) + 1) // 2), lambda k: sha256(h[2 * k + 1] || coalesce(h[2 * k + 2], h[2 * k + 1]))) FROM t WHERE len(h) > 1)
SELECT h[1] AS root, (SELECT count(*) FROM orders) AS n FROM t WHERE len(h) = 1""")
def k4_merkle_root(spark, sf):
    """The Merkle root over the digests of all orders."""
    leaves = V.table(spark, sf, "orders").select(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("leaf"))
    n = leaves.count()
    return spark.range(1).select(F.lit(K.merkle_root(leaves)).alias("root"), F.lit(n).alias("n"))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS leaf, row_number() OVER (ORDER BY sha256(o_orderkey::VARCHAR)) - 1 AS i FROM orders),
t(lvl, h) AS (SELECT 0, list(leaf ORDER BY leaf) FROM o
UNION ALL SELECT lvl + 1, list_transform(range(0, (len(h) + 1) // 2), lambda k: sha256(h[2 * k + 1] || coalesce(h[2 * k + 2], h[2 * k + 1]))) FROM t WHERE len(h) > 1),
s AS (SELECT o.i, lvl, CASE WHEN (i >> lvl) & 1 = 1 THEN '<' || h[i >> lvl] ELSE '>' || coalesce(h[(i >> lvl) + 2], h[(i >> lvl) + 1]) END AS step FROM o JOIN t ON len(h) > 1)
SELECT o_orderkey, count(*)::INT AS n_steps, sha256(string_agg(step, '' ORDER BY lvl)) AS proof, true AS verified FROM o JOIN s USING (i) GROUP BY o_orderkey""")
def k4_inclusion_proofs(spark, sf):
    """A proof for each order that it is under the root of all of them, and whether it gives that root."""
    orders = V.table(spark, sf, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("leaf"))
    tiers = K.merkle_levels(orders)
    found = written(orders.join(K.proof_digests(tiers).hint("merge"), "leaf").select("o_orderkey", "n_steps", "proof", "verified"), "proofs")
    for tier in tiers:
        tier.unpersist()
    return found


@query("SELECT o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS run_id FROM orders")
def k6_stable_ids(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", K.stable_id("o_orderstatus", "o_custkey").alias("run_id"))


@query(sql(_print_sql("SELECT namespace, sha256('{\"instrument_id\":' || instrument_id || ',\"revision\":' || revision || ',\"value\":' || value || ',\"vt\":\"' || vt || '\"}') AS d FROM (SELECT * FROM records WHERE kt <= DATE '2024-01-15' QUALIFY row_number() OVER (PARTITION BY namespace, instrument_id, vt ORDER BY revision DESC) = 1)", "namespace"), "records"))
def k7_query_fingerprint(spark, sf):
    """A fingerprint of each namespace's visible facts."""
    return K.group_fingerprint(B.as_of(V.records(spark, sf), F.lit("2024-01-15").cast("date")), ["namespace"], ["instrument_id", "vt", "revision", "value"])


@query("SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NULL AS only_b, b.o_orderkey IS NULL AS only_a FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus")
def k8_rerun_differences(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    again = o.filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return K.rerun_differences(o.filter("o_orderkey % 10 <> 0"), again, ["o_orderkey"], ["o_orderstatus"])


@query()
def k9_file_digests(spark, sf):
    """Whole-file digests of two tables, held against a manifest that is wrong for one of them and names a file that isn't there."""
    paths = [f"{sf}/{t}.parquet" for t in ("supplier", "orders")]
    name = F.element_at(F.split("file", "/"), -1)
    sealed = I.file_digests(spark, paths).select(name.alias("file"), F.when(name.startswith("orders"), F.reverse("sha256")).otherwise(F.col("sha256")).alias("expected"))
    gone = sealed.filter(name.startswith("orders")).select(F.lit("gone.parquet").alias("file"), "expected")
    return I.verify_files(spark, paths, sealed.unionByName(gone))


@query("SELECT event_id, namespace, coalesce(run_id, 'fixture') AS ingest_run_id, value AS close FROM (SELECT event_id, 'bar' AS namespace, CASE WHEN event_id % 2 = 0 THEN 'r' END AS run_id, value FROM events)")
def a1_a2_json_round_trip(spark, sf):
    """Records appended as JSON lines in two writes and loaded again."""
    path = _folder(spark)
    e = V.table(spark, sf, "events")
    rows = e.select(
        F.lit("bar").alias("namespace"), F.col("event_id").cast("string").alias("instrument_id"), F.to_date("ts").alias("vt"), F.to_date("ts").alias("kt"), F.lit(0).alias("revision"),
        F.struct(F.col("value").alias("close")).alias("payload"), F.when(F.col("event_id") % 2 == 0, "r").alias("ingest_run_id"),
    )
    I.append_records(rows.filter("revision = 0 and cast(instrument_id as bigint) % 3 = 0"), path, "json")
    I.append_records(rows.filter("revision = 0 and cast(instrument_id as bigint) % 3 <> 0"), path, "json")
    return I.read_records(spark, path).select(F.col("instrument_id").cast("bigint").alias("event_id"), "namespace", "ingest_run_id", F.col("payload.close").alias("close"))


@query(sql("SELECT instrument_id, vt, open, high, low, close, volume FROM bars", "bars"))
def a6_a9_vendor_bars(spark, sf):
    """Bars landed as vendor pages, a file for each day, and mapped back to records."""
    path = _folder(spark)
    b = V.bars(spark, sf)
    result = F.struct(
        (F.unix_date("vt").cast("bigint") * 86_400_000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
        F.col("volume").cast("double").alias("v"), F.col("close").alias("vw"), F.col("instrument_id").alias("n"),
    )
    _land(b, result, path)
    pages, _ = I.read_pages(spark, path, I.BAR_PAGE)
    rows = I.bar_records(pages, F.col("r.n"), "run")
    return rows.select("instrument_id", "vt", "open", "high", "low", "close", "volume")


def _land(rows, result, path) -> None:
    """Rows as vendor pages of some hundred results, a file for each page."""
    n = max(1, rows.count() // 500)
    paged = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(n)).alias("page"), result.alias("r"))
    paged.groupBy("page").agg(F.collect_list("r").alias("results")).select("results").write.option("maxRecordsPerFile", 1).json(path)


@query("SELECT event_id, (SELECT count(DISTINCT event_id // 500) FROM events WHERE (event_id // 500) % 5 < 3) AS n_rejected FROM events WHERE (event_id // 500) % 5 >= 3")
def a11_page_rejection(spark, sf):
    """Events as pages of 500, most of them no page: a list, an object without results, or one whose results are no list."""
    path = _folder(spark)
    e = V.table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 500).alias("page"))
    good = e.groupBy("page").agg(F.to_json(F.struct(F.collect_list(F.struct("event_id")).alias("results"))).alias("value"))
    text = F.when(F.col("page") % 5 == 0, "[1, 2]").when(F.col("page") % 5 == 1, '{"status": "ok"}').when(F.col("page") % 5 == 2, '{"results": "none"}').otherwise(F.col("value"))
    good.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows, rejected = I.read_pages(spark, path, "results array<struct<event_id:bigint>>, _bad string")
    count = rejected.agg(F.count_distinct("file").alias("n_rejected"))
    return rows.select("r.event_id").crossJoin(F.broadcast(count))  # one row


@query(sql("SELECT instrument_id, vt, ratio FROM splits UNION ALL SELECT o_custkey % 100, o_orderdate::DATE, NULL FROM orders WHERE o_orderpriority = '2-HIGH'", "splits"))
def a7_a8_a10_actions(spark, sf):
    """Splits and dividends as vendor pages, mapped and put together; the ratio comes from split_from and split_to."""
    s = V.splits(spark, sf)
    a, b = _folder(spark), _folder(spark)
    day = F.col("vt").cast("string")
    _land(s.withColumn("number", F.monotonically_increasing_id()), F.struct(day.alias("execution_date"), F.lit(1.0).alias("split_from"), F.col("ratio").alias("split_to"), F.col("instrument_id")), a)
    o = V.table(spark, sf, "orders").filter("o_orderpriority = '2-HIGH'").select("o_orderkey", (F.col("o_custkey") % 100).alias("instrument_id"), F.to_date("o_orderdate").alias("vt"))
    _land(o, F.struct(day.alias("ex_dividend_date"), F.lit(1.0).alias("cash_amount"), F.col("instrument_id")), b)
    more = lambda schema: schema.replace("array<struct<", "array<struct<instrument_id:bigint,")
    splits, _ = I.read_pages(spark, a, more(I.SPLIT_PAGE))
    dividends, _ = I.read_pages(spark, b, more(I.DIVIDEND_PAGE))
    both = I.actions(I.dividend_records(dividends, F.col("r.instrument_id"), "run"), I.split_records(splits, F.col("r.instrument_id"), "run"))
    return both.select("instrument_id", "vt", "ratio")


@query("SELECT event_id, ts::DATE AS vt FROM events")
def i15_vendor_dates(spark, sf):
    """Days from four forms of vendor dates."""
    ms = (F.unix_date(F.to_date("ts")).cast("bigint") * 86_400_000).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, ms).when(F.col("event_id") % 3 == 1, F.to_date("ts").cast("string")).otherwise(F.concat(F.to_date("ts").cast("string"), F.lit("T12:30:00Z")))
    return V.table(spark, sf, "events").select("event_id", I.vendor_date(text).alias("vt"))


@query("SELECT c_custkey, make_date(y, m, least(d, 28)) AS day FROM (SELECT c_custkey, year(n) AS y, month(n) AS m, day(o) AS d FROM (SELECT c_custkey, o, (date_trunc('month', o) + INTERVAL 2 MONTH)::DATE AS n FROM (SELECT c_custkey, DATE '2023-01-31' + (c_custkey % 300)::INT AS o FROM customer)))")
def i18_months_to_28th(spark, sf):
    from ..sources.fixture import month_after

    day = F.date_add(F.lit("2023-01-31").cast("date"), (F.col("c_custkey") % 300).cast("int"))
    return V.table(spark, sf, "customer").select("c_custkey", month_after(day, 2).alias("day"))


@query("SELECT o_orderkey, list_filter(generate_series(o_orderdate::TIMESTAMP, o_orderdate::TIMESTAMP + INTERVAL 17 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6)[5]::DATE AS fifth FROM orders")
def i17_weekdays(spark, sf):
    """The fifth weekday from each order's day."""
    from ..sources.fixture import weekdays_from

    return V.table(spark, sf, "orders").select("o_orderkey", F.element_at(weekdays_from(F.to_date("o_orderdate"), 5), 5).alias("fifth"))


_NAME_SUM = "list_sum(list_transform(string_split(s_name, ''), lambda x: ascii(x)))::BIGINT"


@query(f"SELECT instrument_id, di, round(50 + base % 20 + di * 0.05::DOUBLE + ((1103515245::HUGEINT * (base * 1000 + di) + 12345) % 2147483648)::BIGINT % 1000 / 200.0::DOUBLE, 4) AS close, 100000 + ((1103515245::HUGEINT * (base * 7 + di) + 12345) % 2147483648)::BIGINT % 50000 AS volume FROM (SELECT s_name AS instrument_id, {_NAME_SUM} AS base FROM supplier), (SELECT unnest(range(60)) AS di)")
def a18_panel_bars(spark, sf):
    """The canonical panel's formulas over all suppliers as symbols."""
    from ..sources.fixture import panel_bars

    base = F.aggregate(F.split("s_name", ""), F.lit(0).cast("bigint"), lambda a, x: a + F.ascii(x))
    s = V.table(spark, sf, "supplier").select(F.col("s_name").alias("instrument_id"), base.alias("base"))
    return panel_bars(s).select("instrument_id", "di", F.round("close", 4).alias("close"), "volume")


@query("SELECT s_name AS instrument_id, round(80 + 7 * s_suppkey + di * (0.08::DOUBLE + 0.015::DOUBLE * s_suppkey) + ((di + 1) * (s_suppkey + 3) % 9) * 0.11::DOUBLE, 6) AS close FROM supplier, (SELECT unnest(range(45)) AS di)")
def a19_close_matrix(spark, sf):
    """The close matrix's formula over all suppliers as symbols."""
    from ..sources.fixture import close_matrix

    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("si"), F.col("s_name").alias("instrument_id"))
    return close_matrix(spark, symbols=s).select("instrument_id", F.round("close", 6).alias("close"))


_BAR_LINE = """'{"instrument_id":"' || s_name || '","kt":"' || d || 'T16:00:01Z","namespace":"bar","payload":{"close":' || c || ',"high":' || (c + 0.5) || ',"low":' || (c - 1) || ',"open":' || (c - 0.5) || ',"volume":' || (1000 + s_suppkey * 100 + n) || '},"revision":1,"source":{"collection_method":"generated","feed":"stocks/eod","vendor":"synthetic"},"superseded_by":null,"vt":"' || d || 'T16:00:00Z"}'"""


@query(f"SELECT sha256({_BAR_LINE}) AS digest FROM (SELECT *, 100.0::DOUBLE + s_suppkey * 10 + n * 0.25::DOUBLE AS c, (DATE '2025-01-01' + n::INT)::VARCHAR AS d FROM supplier, (SELECT unnest(range(20)) AS n))")
def a17_holdout_lines(spark, sf):
    """A holdout of all suppliers as symbols, features and labels written apart; the digest of each line of the features."""
    from ..sources.fixture import holdout, write_holdout

    path = _folder(spark)
    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("instrument_id"))
    write_holdout(holdout(spark, symbols=s), f"{path}/features", f"{path}/labels")
    return spark.read.text(f"{path}/features").select(F.sha2("value", 256).alias("digest"))


@query("SELECT c_custkey, ((1103515245::HUGEINT * c_custkey + 12345) % 2147483648)::BIGINT AS h FROM customer")
def i22_lcg(spark, sf):
    from ..sources.fixture import lcg

    return V.table(spark, sf, "customer").select("c_custkey", lcg(F.col("c_custkey")).alias("h"))


@query(sql("SELECT namespace, instrument_id::VARCHAR AS instrument_id, vt, kt, revision, CASE WHEN revision = 0 THEN round(value, 2)::VARCHAR END AS close FROM (SELECT * FROM records WHERE kt <= DATE '2024-01-10' QUALIFY row_number() OVER (PARTITION BY namespace, instrument_id, vt ORDER BY revision DESC) = 1)", "records"))
def a13_csv_extract(spark, sf):
    """An as-of extract written as CSV and read back; closes of restated facts are left empty."""
    path = _folder(spark)
    rows = B.as_of(V.records(spark, sf), F.lit("2024-01-10").cast("date"))
    I.export_csv(rows.withColumn("close", F.when(F.col("revision") == 0, F.round("value", 2))), path)
    return spark.read.option("header", True).schema("namespace string, instrument_id string, vt date, kt date, revision int, close string").csv(path)


@query(sql("SELECT min(vt) AS first, max(vt) AS last, count(*) AS n, count(DISTINCT instrument_id) AS n_instruments FROM records", "records"))
def a16_manifest_shape(spark, sf):
    return K.manifest(V.records(spark, sf), "m").select("first", "last", "n", "n_instruments")


@query("SELECT event_id, ts::DATE AS vt, (ts + INTERVAL 1 HOUR)::DATE AS kt, 'run' AS ingest_run_id FROM events")
def a12_normalise_times(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.col("ts").alias("vt"), (F.col("ts") + F.expr("interval 1 hour")).alias("kt"))
    return I.to_days(e, "run")


@query("SELECT strategy, count(r) AS n, round(sum(r), 6) AS total FROM (SELECT unnest(['B1', 'B2', 'B3']) AS strategy) LEFT JOIN (SELECT CASE WHEN user_id % 2 = 0 THEN 'B1' ELSE 'B2' END AS strategy, value AS r FROM events) USING (strategy) GROUP BY strategy")
def a24_signals_json(spark, sf):
    """Signals as JSON, a day in pages of a bounded size, wrapped for some days and bare for others; a strategy without signals has no rows but its own."""
    e = V.table(spark, sf, "events")
    e = e.select(F.to_date("ts").alias("day"), F.when(F.col("user_id") % 2 == 0, "B1").otherwise("B2").alias("s"), "value", F.pmod(F.xxhash64("event_id"), F.lit(max(1, e.count() // 10_000))).alias("page"))
    lists = e.groupBy("day", "page", "s").agg(F.collect_list(F.struct(F.col("value").alias("return"), F.lit(1.0).alias("turnover"))).alias("l"))
    maps = lists.groupBy("day", "page").agg(F.map_from_entries(F.collect_list(F.struct("s", "l"))).alias("m"))
    text = F.when(F.day("day") % 2 == 0, F.to_json(F.struct(F.col("m").alias("signals")))).otherwise(F.to_json("m"))
    found = I.signals_from_json(maps.select(text.alias("t")), "t", ["B1", "B2", "B3"])
    return found.groupBy("strategy").agg(F.count("ret").alias("n"), F.round(F.sum("ret"), 6).alias("total"))


@query("SELECT DISTINCT sha256(lang || source) AS hash FROM documents ORDER BY 1")
def a23_evidence_hashes(spark, sf):
    return V.table(spark, sf, "documents").select(F.sha2(F.concat("lang", "source"), 256).alias("hash")).distinct().orderBy("hash")


def _order_runs(spark, sf):
    """Orders as runs: made from their customer's snapshot by their clerk's code."""
    sha = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    return V.table(spark, sf, "orders").select(sha("o_orderkey").alias("run_id"), sha("o_custkey").alias("snapshot_hash"), sha("o_orderpriority").alias("feature_ir_hash"), F.lit("e").alias("experiment_id"), status.alias("status"), F.to_date("o_orderdate").alias("day"))


_RUN = "sha256(o_orderkey::VARCHAR) AS run_id, sha256(o_custkey::VARCHAR) AS snap, sha256(o_orderpriority) AS feat"


@query(f"SELECT run_id AS entity_hash, 'RunRecord' AS entity_type, 'ExperimentRun' AS activity_type, '[' || snap || ', ' || feat || ']' AS derived_from, sha256('{{\"activity_type\":\"ExperimentRun\",\"decided_by\":null,\"derived_from\":[\"' || snap || '\",\"' || feat || '\"],\"entity_hash\":\"' || run_id || '\",\"entity_type\":\"RunRecord\",\"known_at\":\"' || o_orderdate::DATE || '\"}}') AS hash, 'evidence' AS type FROM (SELECT *, {_RUN} FROM orders)")
def p20_evidence_of_runs(spark, sf):
    """The evidence that each run hands to review."""
    made = P.evidence_payload(P.evidence_commit(_order_runs(spark, sf), F.col("day")))
    return made.select("entity_hash", "entity_type", "activity_type", F.concat(F.lit("["), F.array_join("derived_from", ", "), F.lit("]")).alias("derived_from"), "hash", "type")


@query(f"SELECT run_id, 'evidence_reference' AS type, snap AS snapshot_hash, sha256('{{\"run_id\":\"' || run_id || '\",\"experiment_id\":\"e\",\"status\":\"' || CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failed' END || '\",\"feature_ir_hash\":\"' || feat || '\"}}') AS artifact FROM (SELECT *, {_RUN} FROM orders)")
def p20_artifacts_and_references(spark, sf):
    """The artifact of each run, of which some fields are read again, and its short reference."""
    runs = _order_runs(spark, sf)
    read = F.from_json("artifact", "run_id string, experiment_id string, status string, feature_ir_hash string")
    a = P.trial_artifact(runs).select("run_id", F.sha2(F.to_json(read), 256).alias("artifact"))
    return P.evidence_reference(runs).join(a, "run_id").select("run_id", "type", "snapshot_hash", "artifact")


@query("SELECT l_orderkey, array_to_string(list_sort(list(sha256(l_partkey::VARCHAR))), ',') AS manifest, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def p21_receipt_projection(spark, sf):
    """Receipts of orders with a manifest of their lines, without clocks, workers and paths."""
    return P.receipt_projection(_receipts(spark, sf)).select("l_orderkey", F.array_join("artifact_sha256", ",").alias("manifest"), F.size("artifact_sha256").cast("bigint").alias("n"))


def _receipts(spark, sf):
    """Receipts as JSON; clocks and workers differ from one receipt to the next."""
    sha = F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256)
    path = F.concat_ws("/", F.lit("staging"), F.col("l_linenumber").cast("string"))
    lines = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(path.alias("path"), sha.alias("sha256"))).alias("artifact_manifest"))
    work = F.sha2(F.col("l_orderkey").cast("string").cast("binary"), 256)
    receipt = F.struct(work.alias("work_order_hash"), F.lit("completed").alias("terminal_status"), F.array().cast("array<struct<name:string,value:double>>").alias("metrics"), "artifact_manifest", F.rand(3).alias("finished_at"), F.uuid().alias("worker_id"))
    return lines.select("l_orderkey", F.to_json(receipt).alias("receipt"))


@query(_print_sql("SELECT k % 10 AS campaign, sha256('{\"artifact_sha256\":[' || string_agg('\"' || h || '\"', ',' ORDER BY h) || '],\"metrics\":[],\"terminal_status\":\"completed\",\"work_order_hash\":\"' || sha256(k::VARCHAR) || '\"}') AS d FROM (SELECT l_orderkey AS k, sha256(l_partkey::VARCHAR) AS h FROM lineitem) GROUP BY k", "campaign"))
def p21_campaign_fingerprint(spark, sf):
    """Fingerprints of campaigns of orders from their projected receipts."""
    return P.campaign_fingerprint(P.receipt_projection(_receipts(spark, sf)).withColumn("campaign", F.col("l_orderkey") % 10), ["campaign"])


@query("SELECT c_custkey, row_number() OVER (ORDER BY coalesce(CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey::VARCHAR END, ''), c_mktsegment, c_custkey) AS place FROM customer")
def g13_grid_order(spark, sf):
    """Customers as rows of a grid whose dimensions are nations, missing for some, and segments."""
    grid = V.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("nation"), F.col("c_mktsegment").alias("segment"))
    return P.canonical_order(grid, ["nation", "segment"], "c_custkey").select("c_custkey", F.col("place").cast("bigint").alias("place"))


_GRID_STAGES = "SELECT 'train' AS stage, NULL AS lang, seed, source FROM (SELECT DISTINCT source FROM documents), (VALUES ('1'), ('2')) s(seed) UNION ALL SELECT 'evaluate', lang, NULL, source FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT lang FROM documents)"


@query(f"SELECT stage, lang, seed, source, sha256('{{\"stage\":\"' || stage || '\"' || coalesce(',\"lang\":\"' || lang || '\"', '') || coalesce(',\"seed\":\"' || seed || '\"', '') || ',\"source\":\"' || source || '\"}}') AS row_id FROM ({_GRID_STAGES})")
def c7_parameter_grid(spark, sf):
    """A campaign's grid over the data's own dimensions, with an id for each row."""
    d = V.table(spark, sf, "documents")
    sources = [r[0] for r in d.select("source").distinct().collect()]
    langs = [r[0] for r in d.select("lang").distinct().collect()]
    return S.grid_rows(spark, {"train": {"source": sources, "seed": (1, 2)}, "evaluate": {"source": sources, "lang": langs}})


@query("SELECT event_id, namespace, vt FROM (SELECT event_id, ts::DATE AS vt, 'bar' AS namespace FROM events)")
def n1_stream_append(spark, sf):
    """Landed records through the stream: checked, deduplicated and appended, then read back."""
    from ..streaming.append import append_stream, record_stream

    root = _folder(spark)
    e = V.table(spark, sf, "events").select(F.lit("bar").alias("namespace"), F.col("event_id").alias("instrument_id"), F.to_date("ts").alias("vt"), F.to_date("ts").alias("kt"), F.lit(0).alias("revision"), F.col("ts").cast("timestamp").alias("arrived"))
    e.unionByName(e.filter("instrument_id % 10 = 0")).write.parquet(f"{root}/landed")
    rows = record_stream(spark, f"{root}/landed", e.schema, "parquet")
    append_stream(rows, f"{root}/facts", f"{root}/rejected", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/facts").select(F.col("instrument_id").alias("event_id"), "namespace", "vt")


def _changes_sql(k: int) -> str:
    """Keys whose visible fact at one of the times isn't that of the time before."""
    known = lambda j: f"(SELECT namespace, instrument_id, vt, max(revision) AS revision, max_by(value, revision) AS value FROM records WHERE kt <= DATE '{_PINNED[j]}' GROUP BY ALL)"
    was = known(k - 1) if k else f"(SELECT * FROM {known(0)} WHERE false)"
    return f"SELECT {k} AS landing, namespace, instrument_id, vt, revision, a.value AS old_value, b.value AS new_value FROM {known(k)} b LEFT JOIN {was.replace('max(revision) AS revision', 'max(revision) AS before')} a USING (namespace, instrument_id, vt) WHERE before IS DISTINCT FROM revision"


@query(sql(" UNION ALL ".join(map(_changes_sql, range(3))), "records"))
def n1_stream_restatements(spark, sf):
    """Records that land in three parts by knowledge time, and each visible fact that a landing brings or restates."""
    from ..streaming.append import record_stream
    from ..streaming.restate import restatement_stream

    root, since = _folder(spark), "0001-01-01"
    r = V.records(spark, sf)
    for k, until in enumerate(_PINNED):
        r.filter((F.col("kt") > F.lit(since).cast("date")) & (F.col("kt") <= F.lit(until).cast("date"))).write.mode("append").parquet(f"{root}/landed")
        since = until
        rows = record_stream(spark, f"{root}/landed", r.schema, "parquet", files_per_batch=1_000_000)
        restatement_stream(rows, ["value"], f"{root}/changes/landing={k}", f"{root}/progress").awaitTermination()
    found = spark.read.parquet(f"{root}/changes")
    return found.select("landing", "namespace", "instrument_id", "vt", "revision", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))


@query(sql("SELECT 'records-v1' AS manifest_id, count(*) AS n, true AS matches FROM records", "records"))
def a14_a15_freeze(spark, sf):
    """All records frozen as sorted JSON with a manifest, read again and verified against it."""
    path = _folder(spark)
    r = V.records(spark, sf)
    K.freeze(r, path, "records-v1", ["namespace", "instrument_id", "vt", "revision"])
    return K.verify(spark.read.schema(r.schema).json(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")).select("manifest_id", "n", "matches")


@query("SELECT doc_id % 4 = 0 AS broken, count(*) AS n FROM labels GROUP BY ALL")
def a21_a22_artifact_log(spark, sf):
    """Artifacts appended as lines of JSON, some of them broken, and read again: a broken one stays as a violation."""
    path = _folder(spark)
    rows = V.table(spark, sf, "labels").select(F.when(F.col("doc_id") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("run_id"), F.lit("success").alias("status")))).alias("value"))
    I.append_lines(rows, path)
    found = I.read_artifacts(spark, path, "run_id string, status string")
    return found.groupBy((F.col("violation").isNotNull()).alias("broken")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256('{\"epoch\":' || (doc_id % 9) || ',\"features\":\"' || sha256(doc_id::VARCHAR) || '\",\"labels\":\"' || sha256('l' || doc_id) || '\"}') AS commitment, CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS status FROM labels")
def k5_seal_commitment(spark, sf):
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    doc = F.col("doc_id").cast("string")
    rows = V.table(spark, sf, "labels").select("doc_id", "toxic", (F.col("doc_id") % 9).alias("epoch"), sha(doc).alias("features"), sha(F.concat(F.lit("l"), doc)).alias("labels"))
    classes = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", K.stable_id("features", "labels", "epoch").alias("commitment"), F.when(F.size(classes) == 0, "pass").otherwise("fail").alias("status"))
