"""Research tables derived from the given ones, for queries: each once for Spark and once as SQL.

records, bars, a calendar, folds, corporate actions, edges, fundamentals, order
intents, attempt logs and p-values, all deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Namespaces of records, in the order in which instruments are dealt to them.
NAMESPACES = ("bar", "fundamental", "corporate_action", "universe", "macro")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as bitemporal facts: a user's events of a day are revisions of one fact, known up to six days later."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("vt"), "value")
    order = Window.partitionBy("user_id", "vt").orderBy("event_id")
    names = F.array(*map(F.lit, NAMESPACES))
    return e.select(
        F.element_at(names, (F.col("user_id") % 5).cast("int") + 1).alias("namespace"),
        F.col("user_id").alias("instrument_id"), "vt",
        F.date_add("vt", (F.col("event_id") % 7).cast("int")).alias("kt"),
        (F.row_number().over(order) - 1).alias("revision"), "value",
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Events as daily bars of their users."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("instrument_id"), F.to_date("ts").alias("vt"))
    return e.agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"), F.count(F.lit(1)).alias("volume"),
    ).withColumn("kt", F.col("vt"))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Days that have events, with the next one and a number; as many rows as days, whatever the data's size."""
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    order = Window.orderBy("day")
    return days.select("day", F.lead("day").over(order).alias("next_day"), (F.row_number().over(order) - 1).alias("idx"))


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return calendar(spark, sf).filter(F.col("idx").isin(9, 19, 28)).select(F.col("idx").alias("fold_id"), F.col("day").alias("cutoff"), F.col("next_day"))


def long_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as long daily histories of their suppliers, dealt by supplier once for the bars and all windows over them."""
    li = table(spark, sf, "lineitem").repartition("l_suppkey").withColumns({"vt": F.to_date("l_shipdate"), "k": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")})
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return li.groupBy(F.col("l_suppkey").alias("instrument_id"), "vt").agg(
        F.min_by("l_extendedprice", "k").alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        F.max_by("l_extendedprice", "k").alias("close"), F.sum("l_quantity").alias("volume"), (cents / 100 / F.sum("l_quantity")).alias("vwap"),
    )


def splits(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").withColumn("vt", F.to_date("o_orderdate"))
    return o.select(
        (F.col("o_custkey") % 100).alias("instrument_id"), "vt", F.date_sub("vt", (F.col("o_orderkey") % 10).cast("int")).alias("kt"),
        F.when(F.col("o_orderkey") % 2 == 0, 2.0).otherwise(0.5).alias("ratio"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("valid_from", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 365).cast("int")))
    return s.select(
        F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"), F.lit("nation").alias("kind"), "valid_from",
        F.date_add("valid_from", 720).alias("valid_to"), F.date_add("valid_from", (F.col("s_suppkey") % 90).cast("int")).alias("known_at"),
    )


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly sums of orders, known 45 days later; every third customer's are restated 60 days after that."""
    end = F.date_sub(F.add_months(F.trunc("o_orderdate", "quarter"), 3), 1)
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("instrument_id"), end.alias("vt"))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    first = o.agg(cents.alias("cents")).select("instrument_id", "vt", F.date_add("vt", 45).alias("kt"), F.lit(0).alias("revision"), (F.col("cents") / 100).alias("revenue"))
    again = F.when(F.col("instrument_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return first.withColumn("revision", F.explode(again)).select(
        "instrument_id", "vt", F.date_add("kt", 60 * F.col("revision")).alias("kt"), "revision", (F.col("revenue") - F.col("revision") * 1000.25).alias("revenue")
    )


def intents(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as order intents of customers, with the customer's portfolio."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = li.join(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1e6).alias("notional"), F.when(F.col("l_returnflag") == "N", "buy").otherwise("sell").alias("side"),
        (F.abs("c_acctbal") / 1e4).alias("gross"), (F.col("c_acctbal") / 2e4).alias("net"), (F.greatest(-F.col("c_acctbal"), F.lit(0.0)) / 1e4).alias("loss"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log of attempts: four entries an attempt, most of whose changes of state are illegal."""
    e = table(spark, sf, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    state = F.element_at(F.create_map(*map(F.lit, ("signup", "issued", "view", "queued", "click", "running", "purchase", "completed", "error", "failed"))), F.col("event_type"))
    return e.select(F.col("user_id").alias("work_order"), F.floor(F.col("n") / 4).cast("bigint").alias("retry_seq"), state.alias("state"), "event_id", F.col("n").alias("seq"))


def pvalues(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.pow(((F.col("doc_id") * 7919) % 1000 + 1) / 1000.0, F.lit(3)).alias("p"), F.col("quality").alias("lane"))


#: The same tables as SQL.
SQL = {
    "records": """SELECT ['bar', 'fundamental', 'corporate_action', 'universe', 'macro'][(user_id % 5)::INT + 1] AS namespace, user_id AS instrument_id, ts::DATE AS vt,
      ts::DATE + (event_id % 7)::INT AS kt, (row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) - 1)::INT AS revision, value FROM events""",
    "bars": """SELECT user_id AS instrument_id, ts::DATE AS vt, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close,
      count(*) AS volume, ts::DATE AS kt FROM events GROUP BY user_id, ts::DATE""",
    "calendar": "SELECT day, lead(day) OVER (ORDER BY day) AS next_day, (row_number() OVER (ORDER BY day) - 1)::INT AS idx FROM (SELECT DISTINCT ts::DATE AS day FROM events)",
    "folds": "SELECT idx AS fold_id, day AS cutoff, next_day FROM calendar WHERE idx IN (9, 19, 28)",
    "long_bars": """SELECT l_suppkey AS instrument_id, l_shipdate::DATE AS vt,
      first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
      first(l_extendedprice ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS close, sum(l_quantity) AS volume,
      sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100 / sum(l_quantity) AS vwap FROM lineitem GROUP BY l_suppkey, l_shipdate::DATE""",
    "splits": """SELECT o_custkey % 100 AS instrument_id, o_orderdate::DATE AS vt, o_orderdate::DATE - (o_orderkey % 10)::INT AS kt,
      CASE WHEN o_orderkey % 2 = 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS ratio FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "edges": """SELECT s_suppkey AS src, s_nationkey AS dst, 'nation' AS kind, vf AS valid_from, vf + 720 AS valid_to, vf + (s_suppkey % 90)::INT AS known_at
      FROM (SELECT *, DATE '1995-01-01' + (s_suppkey % 365)::INT AS vf FROM supplier)""",
    "fundamentals": """SELECT instrument_id, vt, vt + 45 + 60 * r AS kt, r AS revision, cents / 100.0::DOUBLE - r * 1000.25::DOUBLE AS revenue
      FROM (SELECT o_custkey AS instrument_id, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE - 1 AS vt, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1, 2),
      (VALUES (0), (1)) v(r) WHERE r = 0 OR instrument_id % 3 = 0""",
    "intents": """SELECT l_orderkey, l_linenumber, l_extendedprice / 1e6 AS notional, CASE WHEN l_returnflag = 'N' THEN 'buy' ELSE 'sell' END AS side,
      abs(c_acctbal) / 1e4 AS gross, c_acctbal / 2e4 AS net, greatest(-c_acctbal, 0.0) / 1e4 AS loss
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "attempts": """SELECT user_id AS work_order, (n // 4)::BIGINT AS retry_seq, CASE event_type WHEN 'signup' THEN 'issued' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running'
      WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS state, event_id, n AS seq
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)""",
    "pvalues": "SELECT doc_id, pow(((doc_id * 7919) % 1000 + 1) / 1000.0::DOUBLE, 3) AS p, quality AS lane FROM labels",
    "fold_facts": """SELECT r.*, fold_id, cutoff FROM (SELECT *, 0 AS _ FROM records) r JOIN folds ON r.vt <= cutoff AND r.kt <= cutoff
      QUALIFY row_number() OVER (PARTITION BY fold_id, namespace, instrument_id, vt ORDER BY revision DESC) = 1""",
    "labels_next": """SELECT b.instrument_id, b.vt, n.close / b.close - 1 AS fwd FROM bars b JOIN calendar ON b.vt = day JOIN bars n ON n.instrument_id = b.instrument_id AND n.vt = next_day
      WHERE b.close <> 0""",
}
NEEDS = {"folds": ("calendar",), "fold_facts": ("records", "folds"), "labels_next": ("bars", "calendar")}


def sql(query: str, *names: str) -> str:
    """``query`` with the derived tables that it names, and those that they need, before it."""
    order: list[str] = []

    def want(name: str) -> None:
        for below in NEEDS.get(name, ()):
            want(below)
        if name not in order:
            order.append(name)

    for name in names:
        want(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + query
