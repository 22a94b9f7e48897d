"""Queries over bitemporal facts: visibility, joins, checks and the canned point-in-time set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitemporal as B
from ..operators import labels as L
from ..operators.snapshots import FactStore
from . import views as V
from .folders import new_folder, written
from .registry import query
from .views import sql

MID = "2024-01-15"


def _day(d: str = MID):
    return F.lit(d).cast("date")


_AS_OF = """SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY namespace, instrument_id, vt ORDER BY revision DESC) AS rn FROM records WHERE {where}) WHERE rn = 1"""
_ALL = "namespace, instrument_id, vt, kt, revision, value"


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-15'"), "records"))
def c1_as_of(spark, sf):
    return B.as_of(V.records(spark, sf), _day())


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-15' AND vt = DATE '2024-01-15'"), "records"))
def m1_cross_section(spark, sf):
    return B.as_of(V.records(spark, sf), _day(), vt_start=_day(), vt_end=_day())


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-15' AND namespace = 'bar' AND instrument_id = 15"), "records"))
def m2_deep_history(spark, sf):
    return B.as_of(V.records(spark, sf), _day(), "bar", [15])


@query(sql("SELECT namespace, instrument_id, vt, kt, revision, value FROM records WHERE kt BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'", "records"))
def m3_revisions(spark, sf):
    return B.revisions(V.records(spark, sf), _day("2024-01-10"), _day("2024-01-12")).orderBy("kt", "namespace", "instrument_id", "vt", "revision")


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-10' AND namespace = 'fundamental'"), "records"))
def m4a_before_restatement(spark, sf):
    return B.as_of(V.records(spark, sf), _day("2024-01-10"), "fundamental")


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-20' AND namespace = 'fundamental'"), "records"))
def m4b_after_restatement(spark, sf):
    return B.as_of(V.records(spark, sf), _day("2024-01-20"), "fundamental")


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-15' AND namespace = 'universe'"), "records"))
def m5_universe(spark, sf):
    return B.as_of(V.records(spark, sf), _day(), "universe")


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-15' AND namespace = 'corporate_action' AND vt >= DATE '2024-01-05'"), "records"))
def m6_corporate_actions(spark, sf):
    return B.as_of(V.records(spark, sf), _day(), "corporate_action", vt_start=_day("2024-01-05"))


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-20' AND namespace = 'bar' AND vt BETWEEN DATE '2024-01-03' AND DATE '2024-01-18'"), "records"))
def m7_training_window(spark, sf):
    return B.as_of(V.records(spark, sf), _day("2024-01-20"), "bar", vt_start=_day("2024-01-03"), vt_end=_day("2024-01-18"))


@query(sql("SELECT namespace, instrument_id, vt, max(revision) AS revision, count(*) AS n FROM records GROUP BY ALL", "records"))
def d1_max_revision(spark, sf):
    return V.records(spark, sf).groupBy(*B.KEY).agg(F.max("revision").alias("revision"), F.count(F.lit(1)).alias("n"))


@query(sql("SELECT namespace, instrument_id, vt, kt, revision, value, value IS NULL AS no_value FROM records", "records"))
def a4_dump(spark, sf):
    return V.records(spark, sf).withColumn("no_value", F.col("value").isNull())


@query(sql("SELECT namespace, instrument_id, vt, kt, revision, value FROM records WHERE vt >= DATE '2024-01-20' AND kt <= DATE '2024-01-25'", "records"))
def a3_scan(spark, sf):
    return V.records(spark, sf).filter((F.col("vt") >= _day("2024-01-20")) & (F.col("kt") <= _day("2024-01-25")))


@query("""SELECT event_id, v FROM (SELECT event_id, list_filter([CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'namespace' END, CASE WHEN value < 1 THEN 'revision' END], lambda x: x IS NOT NULL) AS l,
 array_to_string(l, ',') AS v FROM events) WHERE v <> ''""")  # fmt: skip
def p1_quarantine(spark, sf):
    e = V.table(spark, sf, "events")
    names = F.element_at(F.create_map(*map(F.lit, ("view", "bar", "click", "fundamental", "purchase", "universe", "signup", "macro", "error", "unknown"))), F.col("event_type"))
    rows = e.select("event_id", names.alias("namespace"), F.col("user_id").alias("instrument_id"), F.to_date("ts").alias("vt"), F.to_date("ts").alias("kt"), F.when(F.col("value") < 1, -1).otherwise(0).alias("revision"))
    return B.quarantine(rows)[1].select("event_id", F.array_join("violations", ",").alias("v"))


@query(sql(_AS_OF.format(cols="instrument_id, vt, revision, value", where="kt <= DATE '2024-01-15' AND instrument_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"), "records"))
def p2_universe_filter(spark, sf):
    members = V.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("instrument_id"))
    return B.as_of(V.records(spark, sf), _day(), instruments=members).select("instrument_id", "vt", "revision", "value")


@query(sql("SELECT namespace, count(*) AS n, max(kt) AS last_known FROM records WHERE vt BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' AND kt <= DATE '2024-01-12' GROUP BY namespace", "records"))
def p3_p4_ranges(spark, sf):
    rows = V.records(spark, sf).filter(F.col("vt").between(_day("2024-01-08"), _day("2024-01-12")) & (F.col("kt") <= _day("2024-01-12")))
    return rows.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.max("kt").alias("last_known"))


@query("SELECT event_id, CAST(props->>'k' AS DOUBLE) AS k FROM events")
def p5_payload_field(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query(
    sql(
        """SELECT c.i >= 4 AND c.d >= 10 AND c.e = 0 AS ok,
 CASE WHEN c.i < 4 THEN 'instruments ' || c.i || '/4' WHEN c.d < 10 THEN 'days ' || c.d || '/10' WHEN c.e > 0 THEN 'known too early ' || c.e
 ELSE 'ok ' || c.i || '/' || c.d || '/' || c.n END AS message
FROM (SELECT count(DISTINCT CASE WHEN namespace = 'bar' THEN instrument_id END) AS i, count(DISTINCT CASE WHEN namespace = 'bar' THEN vt END) AS d,
 count(*) FILTER (kt < vt AND namespace NOT IN ('corporate_action', 'universe')) AS e, count(DISTINCT namespace) AS n FROM records) c""",
        "records",
    )
)
def p17_depth(spark, sf):
    return B.depth(V.records(spark, sf))


@query(sql("SELECT src, dst, kind, valid_from, valid_to, known_at FROM edges WHERE valid_from <= DATE '1995-09-01' AND valid_to >= DATE '1995-09-01' AND known_at <= DATE '1995-10-01'", "edges"))
def p18_edges_as_of(spark, sf):
    return B.edges_as_of(V.edges(spark, sf), _day("1995-09-01"), _day("1995-10-01"))


@query(sql("SELECT src::VARCHAR || '->' || dst::VARCHAR AS instrument_id, valid_from AS vt, known_at AS kt, 0 AS revision, kind, valid_to FROM edges", "edges"))
def p19_edge_records(spark, sf):
    return B.edges_as_records(V.edges(spark, sf)).select("instrument_id", "vt", "kt", "revision", "payload.kind", "payload.valid_to")


@query(sql("SELECT * EXCLUDE (_) FROM fold_facts", "fold_facts"))
def c4_walk_forward_folds(spark, sf):
    return B.as_of_folds(V.records(spark, sf), V.folds(spark, sf))


@query(sql("SELECT fold_id, cutoff, namespace, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM fold_facts GROUP BY ALL", "fold_facts"))
def c4_fold_totals(spark, sf):
    """Facts and their sum that each fold sees, by differences between folds."""
    return B.fold_totals(V.records(spark, sf), V.folds(spark, sf), ["namespace"], {"cents": F.round(F.col("value") * 100).cast("bigint")})


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-15'"), "records"))
def c1_snapshot_as_of(spark, sf):
    """All records known by a day, read from a store's snapshot of an earlier day and the facts since."""
    store = _store(spark, sf)
    found = written(store.as_of(MID), "as_of").select(*_ALL.split(", "))
    store.drop()
    return found


@query(sql(_AS_OF.format(cols=_ALL, where="kt <= DATE '2024-01-15' AND namespace = 'bar' AND instrument_id = 15"), "records"))
def m2_snapshot_history(spark, sf):
    """One instrument's history as known by a day, from a store's snapshot and tail."""
    store = _store(spark, sf)
    found = written(store.as_of(MID, "bar", [15]), "history").select(*_ALL.split(", "))
    store.drop()
    return found


def _store(spark, sf):
    """A store of all records, appended in two batches, with snapshots after each."""
    folder = new_folder(spark)
    store = FactStore(spark, f"facts_{folder.rsplit('-', 1)[-1].replace('/', '_')}", path=folder)
    r = V.records(spark, sf)
    store.append(r.filter(F.col("kt") <= _day("2024-01-08")))
    store.compact("2024-01-08")
    store.append(r.filter(F.col("kt") > _day("2024-01-08")))
    store.compact("2024-01-12")
    return store


@query(sql("SELECT instrument_id, vt, round(fwd, 6) AS fwd FROM labels_next", "labels_next"))
def c2_next_day_label(spark, sf):
    return L.next_day_returns(V.bars(spark, sf), V.calendar(spark, sf)).withColumn("fwd", F.round("fwd", 6))


@query(sql("SELECT b.instrument_id, b.vt, b.close AS signal, round(fwd, 6) AS fwd FROM bars b JOIN labels_next USING (instrument_id, vt)", "bars", "labels_next"))
def c3_signal_labels(spark, sf):
    bars = V.bars(spark, sf)
    labels = L.next_day_returns(bars, V.calendar(spark, sf))
    return bars.select("instrument_id", "vt", F.col("close").alias("signal")).join(labels, ["instrument_id", "vt"]).withColumn("fwd", F.round("fwd", 6))


_POINTS = "(SELECT c_custkey % 100 AS instrument_id, c_custkey AS point, DATE '1996-01-01' + (c_custkey % 700)::INT AS vt, DATE '1996-01-01' + (c_custkey % 650)::INT AS kt FROM customer)"


def _points(spark, sf):
    base = F.lit("1996-01-01").cast("date")
    return V.table(spark, sf, "customer").select(
        (F.col("c_custkey") % 100).alias("instrument_id"), F.col("c_custkey").alias("point"),
        F.date_add(base, (F.col("c_custkey") % 700).cast("int")).alias("vt"), F.date_add(base, (F.col("c_custkey") % 650).cast("int")).alias("kt"),
    )


@query(sql(f"SELECT p.*, coalesce(pow(2, sum(CASE WHEN s.ratio = 2 THEN 1 WHEN s.ratio = 0.5 THEN -1 END)), 1.0) AS split_ratio FROM {_POINTS} p LEFT JOIN splits s ON s.instrument_id = p.instrument_id AND s.vt <= p.vt AND s.kt <= p.kt GROUP BY ALL", "splits"))
def c5_split_ratio(spark, sf):
    return B.split_ratio(_points(spark, sf), V.splits(spark, sf))


@query(sql(f"SELECT p.instrument_id, p.point, count(s.ratio) AS n_splits FROM {_POINTS} p LEFT JOIN splits s ON s.instrument_id = p.instrument_id AND s.vt <= p.vt AND s.kt <= p.kt GROUP BY ALL", "splits"))
def d8_split_count(spark, sf):
    return B.split_count(_points(spark, sf), V.splits(spark, sf)).select("instrument_id", "point", "n_splits")


@query(sql("SELECT b.instrument_id, b.vt, round(b.close / pow(2, (b.instrument_id % 3)), 6) AS adjusted, b.close AS raw FROM bars b", "bars"))
def i14_apply_split(spark, sf):
    ratio = F.pow(F.lit(2.0), F.col("instrument_id") % 3)
    return V.bars(spark, sf).select("instrument_id", "vt", F.round(B.apply_split(F.col("close"), ratio, "SplitAdjusted"), 6).alias("adjusted"), B.apply_split(F.col("close"), ratio, "Raw").alias("raw"))


@query(sql("SELECT o_orderkey, src, dst, vt FROM (SELECT o_orderkey, (o_orderkey % 25)::INT AS dst, o_orderdate::DATE AS vt FROM orders) o JOIN edges e USING (dst) WHERE valid_from <= vt AND valid_to >= vt AND known_at <= vt", "edges"))
def c6_interval_join(spark, sf):
    points = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).cast("int").alias("dst"), F.to_date("o_orderdate").alias("vt"))
    return B.edges_at_points(V.edges(spark, sf), points, ["dst"]).select("o_orderkey", "src", "dst", "vt")


@query(
    sql(
        """SELECT o.o_orderkey, o.instrument_id, o.vt, f.vt AS revenue_vt, round(f.revenue, 4) AS revenue
FROM (SELECT o_orderkey, o_custkey AS instrument_id, o_orderdate::DATE AS vt FROM orders) o LEFT JOIN fundamentals f ON f.instrument_id = o.instrument_id AND f.vt <= o.vt AND f.kt <= o.vt
QUALIFY row_number() OVER (PARTITION BY o.o_orderkey ORDER BY f.vt DESC NULLS LAST, f.revision DESC) = 1""",
        "fundamentals",
    )
)
def c14_point_in_time_join(spark, sf):
    left = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("instrument_id"), F.to_date("o_orderdate").alias("vt"))
    return B.known_join(left, V.fundamentals(spark, sf), "instrument_id", "revenue").withColumn("revenue", F.round("revenue", 4))


@query(
    sql(
        """SELECT namespace, instrument_id, vt, a.value AS old_value, b.value AS new_value FROM
(SELECT namespace, instrument_id, vt, arg_max(value, revision) AS value, max(revision) AS r FROM records WHERE kt <= DATE '2024-01-12' GROUP BY ALL) a FULL JOIN
(SELECT namespace, instrument_id, vt, arg_max(value, revision) AS value, max(revision) AS r FROM records WHERE kt <= DATE '2024-01-16' GROUP BY ALL) b USING (namespace, instrument_id, vt)
WHERE a.r IS DISTINCT FROM b.r""",
        "records",
    )
)
def c15_restated(spark, sf):
    return B.restated(V.records(spark, sf), _day("2024-01-12"), _day("2024-01-16"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, count(*)::BIGINT AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a20_duplicate_keys(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return B.duplicate_keys(li, key=("k", "n")).join(li.groupBy("k", "n").agg(F.count(F.lit(1)).alias("copies")), ["k", "n"])


@query(sql("SELECT instrument_id, vt, revision FROM records r WHERE EXISTS (SELECT 1 FROM records x WHERE x.namespace = r.namespace AND x.instrument_id = r.instrument_id AND x.vt = r.vt AND x.revision > r.revision AND x.kt < r.kt)", "records"))
def t2_overtaken_revisions(spark, sf):
    """Facts of which a higher revision was known earlier: a running minimum over the higher revisions."""
    above = Window.partitionBy(*B.KEY).orderBy(F.desc("revision")).rowsBetween(Window.unboundedPreceding, -1)
    return V.records(spark, sf).withColumn("m", F.min("kt").over(above)).filter("m < kt").select("instrument_id", "vt", "revision")


@query("SELECT n_name AS namespace FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def c10_missing_sets(spark, sf):
    have = V.table(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return V.table(spark, sf, "nation").join(have, "n_nationkey", "left_anti").select(F.col("n_name").alias("namespace"))


@query(sql("SELECT count(DISTINCT instrument_id) AS instruments, count(DISTINCT vt) AS days, count(DISTINCT namespace) AS namespaces FROM records", "records"))
def d13_distinct_counts(spark, sf):
    return V.records(spark, sf).agg(F.count_distinct("instrument_id").alias("instruments"), F.count_distinct("vt").alias("days"), F.count_distinct("namespace").alias("namespaces"))
