"""The canonical synthetic panel: six symbols over sixty weekdays, and its facts, from integer formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the panel.
SYMBOLS = ("AAA", "BBB", "CCC", "DDD", "EEE", "ZZZ")
FIRST_DAY, DAYS = "2024-01-02", 60
QUARTERS = ("2023-09-30", "2023-12-31")
NO_PAYLOAD = {"close": "double", "open": "double", "high": "double", "low": "double", "volume": "bigint", "revenue": "bigint", "kind": "string", "ratio": "double", "in_universe": "boolean"}


def lcg(x: Column) -> Column:
    return F.pmod(F.lit(1103515245) * x + F.lit(12345), F.lit(1 << 31))


def weekdays(spark: SparkSession, first: str = FIRST_DAY, n: int = DAYS) -> DataFrame:
    """(di, vt) of the first ``n`` weekdays from ``first``."""
    return spark.range(1).select(F.posexplode(weekdays_from(F.lit(first).cast("date"), n)).alias("di", "vt"))


def weekdays_from(day: Column, n: int) -> Column:
    """The first ``n`` weekdays from a day, itself included."""
    return F.slice(F.filter(F.sequence(day, F.date_add(day, 2 * n + 7)), lambda d: F.weekday(d) < 5), 1, n)


def month_after(day: Column, months: int) -> Column:
    """The same day some months later, at most the 28th."""
    at = F.add_months(F.trunc(day, "month"), months)
    return F.make_date(F.year(at), F.month(at), F.least(F.day(day), F.lit(28)))


def panel_bars(symbols: DataFrame, n: int = DAYS) -> DataFrame:
    """Bars of symbols (instrument_id, base) over ``n`` weekdays; base is the sum of a name's character codes."""
    grid = symbols.select("*", F.posexplode(weekdays_from(F.lit(FIRST_DAY).cast("date"), n)).alias("di", "vt"))
    close = F.round(50 + F.col("base") % 20 + F.col("di") * 0.05 + (lcg(F.col("base") * 1000 + F.col("di")) % 1000) / 200, 4)
    bars = grid.withColumns({"namespace": F.lit("bar"), "kt": F.col("vt"), "revision": F.lit(0), "close": close})
    return bars.withColumns({"open": F.col("close") - 0.1, "high": F.col("close") + 0.25, "low": F.col("close") - 0.3, "volume": 100000 + lcg(F.col("base") * 7 + F.col("di")) % 50000})


def panel(spark: SparkSession) -> DataFrame:
    """All 383 records: bars, fundamentals with restatements, one split and the universe's changes."""
    s = spark.createDataFrame([(i, n, sum(map(ord, n))) for i, n in enumerate(SYMBOLS)], "si bigint, instrument_id string, base bigint")
    fill = lambda df: df.select("namespace", "instrument_id", "vt", "kt", "revision", *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in NO_PAYLOAD.items()))

    bars = panel_bars(s)

    q = s.select("si", "instrument_id", F.posexplode(F.array(*(F.lit(d).cast("date") for d in QUARTERS))).alias("qi", "vt"))
    q = q.withColumns({"namespace": F.lit("fundamental"), "revision": F.lit(0), "kt": F.date_add(month_after(F.col("vt"), 1), 15), "revenue": (1000 + 100 * F.col("si") + 25 * F.col("qi")).cast("bigint")})
    again = q.filter((2 * F.col("si") + F.col("qi")) % 5 == 0).withColumns({"revision": F.lit(1), "revenue": F.col("revenue") + 100, "kt": month_after(F.col("kt"), 2)})

    day = lambda d: F.lit(d).cast("date")
    split = s.filter("instrument_id = 'CCC'").withColumns({"namespace": F.lit("corporate_action"), "vt": day("2024-02-15"), "kt": day("2024-02-01"), "revision": F.lit(0), "kind": F.lit("split"), "ratio": F.lit(2.0)})
    members = s.withColumns({"namespace": F.lit("universe"), "vt": day(FIRST_DAY), "kt": day(FIRST_DAY), "revision": F.lit(0), "in_universe": F.lit(True)})
    out = s.filter("instrument_id = 'ZZZ'").withColumns({"namespace": F.lit("universe"), "vt": day("2024-02-20"), "kt": day("2024-02-13"), "revision": F.lit(1), "in_universe": F.lit(False)})
    parts = [fill(df) for df in (bars, q, again, split, members, out)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def holdout(spark: SparkSession, days: int = 20, symbols: tuple[str, ...] | DataFrame = SYMBOLS[:5], first: str = "2025-01-01") -> DataFrame:
    """(line, label): canonical JSON of generated bars, and apart from it the label of each; symbols are names or a table (k, instrument_id)."""
    s = symbols if isinstance(symbols, DataFrame) else spark.createDataFrame(list(enumerate(symbols)), "k bigint, instrument_id string")
    grid = s.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    day = F.date_add(F.lit(first).cast("date"), F.col("n")).cast("string")
    close = F.lit(100.0) + F.col("k") * 10 + F.col("n") * 0.25
    at = F.concat(day, F.lit("T16:00:00Z")).alias("vt")
    payload = F.struct(close.alias("close"), (close + 0.5).alias("high"), (close - 1).alias("low"), (close - 0.5).alias("open"), (1000 + F.col("k") * 100 + F.col("n")).alias("volume"))
    source = F.struct(F.lit("generated").alias("collection_method"), F.lit("stocks/eod").alias("feed"), F.lit("synthetic").alias("vendor"))
    record = F.struct(
        "instrument_id", F.concat(day, F.lit("T16:00:01Z")).alias("kt"), F.lit("bar").alias("namespace"), payload.alias("payload"), F.lit(1).alias("revision"),
        source.alias("source"), F.lit(None).cast("string").alias("superseded_by"), at,
    )
    label = F.struct(at.alias("as_of"), F.round((F.col("k") - 2) * 0.01 + F.col("n") * 0.0001, 6).alias("future_return"), "instrument_id")
    return grid.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("line"), F.to_json(label).alias("label"))


def write_holdout(rows: DataFrame, features: str, labels: str) -> None:
    """Features and labels in separate places."""
    rows.select("line").write.text(features)
    rows.select("label").write.text(labels)


def close_matrix(spark: SparkSession, days: int = 45, symbols: tuple[str, ...] | DataFrame = SYMBOLS[:4]) -> DataFrame:
    """(vt, instrument_id, close) of four symbols over 45 weekdays, by a formula; symbols are names or a table (si, instrument_id)."""
    s = symbols if isinstance(symbols, DataFrame) else spark.createDataFrame(list(enumerate(symbols)), "si bigint, instrument_id string")
    grid = s.select("*", F.posexplode(weekdays_from(F.lit(FIRST_DAY).cast("date"), days)).alias("di", "vt"))
    close = 80 + 7 * F.col("si") + F.col("di") * (0.08 + 0.015 * F.col("si")) + ((F.col("di") + 1) * (F.col("si") + 3) % 9) * 0.11
    return grid.select("vt", "instrument_id", close.alias("close"))
