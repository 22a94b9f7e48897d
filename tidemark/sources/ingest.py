"""Records and vendor pages from files, and records to files."""

from __future__ import annotations

import decimal
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "namespace string, instrument_id string, vt date, kt date, revision int, "
    "payload struct<open:double,high:double,low:double,close:double,volume:bigint,vwap:double,trades:bigint,revenue:bigint,period:string,kind:string,ratio:double,split_from:double,split_to:double,amount:double,currency:string,index:string,in_universe:boolean,reason:string>, "
    "source string, ingest_run_id string, superseded_by int"
)
BAR_PAGE = "results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double,vw:double,n:bigint>>, next_url string, _bad string"
DIVIDEND_PAGE = "results array<struct<ex_dividend_date:string,cash_amount:double,currency:string,declaration_date:string,record_date:string,pay_date:string,frequency:int>>, _bad string"
SPLIT_PAGE = "results array<struct<execution_date:string,split_from:double,split_to:double>>, _bad string"

#: The last millisecond of the year 9999.
LAST_MS = 253_402_300_799_999


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records from JSON lines; a missing run id is "fixture", blank lines are passed over."""
    return spark.read.schema(RECORD).json(path).withColumn("ingest_run_id", F.coalesce("ingest_run_id", F.lit("fixture")))


def append_records(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Append; what is there is never rewritten.  Parquet is partitioned by namespace."""
    writer = rows.write.mode("append")
    (writer.partitionBy("namespace") if form == "parquet" else writer).format(form).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low, high, parts: int, **options: str) -> DataFrame:
    """A table over JDBC in ranges of a column (numbers, days or times) between two bounds; filters are pushed to the server."""
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()


def _literal(value) -> str:
    return str(value) if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def even_predicates(spark: SparkSession, url: str, table: str, columns: Sequence[str], parts: int, where: str = "1 = 1", quote: str = '"', **options: str) -> list[str]:
    """Conditions that deal a server's rows to about ``parts`` even reads; every row meets exactly one, nulls the first.

    The server is asked for the values that stand at even places of the first
    column (one row each, in standard SQL, best behind an index).  A value that
    fills several places is parted by the next column in the same way.  Ranges
    are open at both ends, so rows that come between the questions and the read are read too.
    """

    def ask(text: str):
        return spark.read.format("jdbc").options(url=url, query=text, **options).load().first()

    n = ask(f"SELECT COUNT(*) AS n FROM {table} WHERE {where}")[0]
    if parts <= 1 or not columns or not n:
        return [where]
    column, rest = f"{quote}{columns[0]}{quote}", columns[1:]
    held = ask(f"SELECT COUNT({column}) AS n FROM {table} WHERE {where}")[0]  # those that aren't null
    if not held:
        return even_predicates(spark, url, table, rest, parts, where, quote, **options)
    at = [held * k // parts for k in range(1, parts)]
    found = [ask(f"SELECT {column} AS v FROM {table} WHERE {where} AND {column} IS NOT NULL ORDER BY {column} OFFSET {k} ROWS FETCH NEXT 1 ROWS ONLY")[0] for k in at]
    ends = list(dict.fromkeys(found))
    out = [f"{where} AND ({column} < {_literal(ends[0])} OR {column} IS NULL)"]
    for k, end in enumerate(ends):
        below = f" AND {column} < {_literal(ends[k + 1])}" if k + 1 < len(ends) else ""
        if found.count(end) > 1:
            out += even_predicates(spark, url, table, rest, found.count(end), f"{where} AND {column} = {_literal(end)}", quote, **options)
            out.append(f"{where} AND {column} > {_literal(end)}{below}")
        else:
            out.append(f"{where} AND {column} >= {_literal(end)}{below}")
    return out


def read_jdbc_evenly(spark: SparkSession, url: str, table: str, columns: Sequence[str], parts: int, quote: str = '"', **options: str) -> DataFrame:
    """A table over JDBC in even reads whatever the spread of ``columns``; filters and columns go to the server, as in ``as_of`` of it."""
    return spark.read.jdbc(url, table, predicates=even_predicates(spark, url, table, columns, parts, quote=quote, **options), properties=options)


def write_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.jdbc(url, table, mode="append", properties=options)


def read_pages(spark: SparkSession, path: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): results of all landed page files with their file, and pages that are no object or have no list of results."""
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = raw.select("results", "_bad", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed"))
    bad = F.col("_bad").isNotNull() | F.col("results").isNull()
    return raw.filter(~bad).select("file", "landed", F.explode("results").alias("r")), raw.filter(bad).select("file", "_bad")


def vendor_date(text: Column) -> Column:
    """Epoch milliseconds (digits, however many), an ISO day or an ISO time with Z, as a day; null past the year 9999."""
    text = text.cast("string")
    digits = F.regexp_like(text, F.lit(r"^[0-9]+$"))
    ms = F.when(digits, text.try_cast("bigint"))
    return F.when(digits, F.to_date(F.timestamp_millis(F.when(ms <= LAST_MS, ms)))).otherwise(F.coalesce(F.to_date(F.try_to_timestamp(text)), F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.to_date(F.try_to_timestamp(F.substring(text, 1, 10))))))


def bar_records(pages: DataFrame, instrument: Column, run_id: str) -> DataFrame:
    r = lambda n: F.col(f"r.{n}")
    return pages.select(
        F.lit("bar").alias("namespace"), instrument.alias("instrument_id"), F.to_date(F.timestamp_millis(r("t"))).alias("vt"), F.to_date("landed").alias("kt"), F.lit(0).alias("revision"),
        r("o").alias("open"), r("h").alias("high"), r("l").alias("low"), r("c").alias("close"), r("v").cast("bigint").alias("volume"), r("vw").alias("vwap"), r("n").alias("trades"),
        F.lit(run_id).alias("ingest_run_id"),
    )


def dividend_records(pages: DataFrame, instrument: Column, run_id: str) -> DataFrame:
    r = lambda n: F.col(f"r.{n}")
    return pages.select(
        F.lit("corporate_action").alias("namespace"), instrument.alias("instrument_id"), vendor_date(r("ex_dividend_date")).alias("vt"), F.to_date("landed").alias("kt"), F.lit(0).alias("revision"),
        F.lit("dividend").alias("kind"), r("cash_amount").alias("amount"), "r.currency", "r.declaration_date", "r.record_date", "r.pay_date", "r.frequency", F.lit(run_id).alias("ingest_run_id"),
    )


def split_records(pages: DataFrame, instrument: Column, run_id: str) -> DataFrame:
    """Splits; the ratio is what one old share becomes."""
    r = lambda n: F.col(f"r.{n}")
    return pages.select(
        F.lit("corporate_action").alias("namespace"), instrument.alias("instrument_id"), vendor_date(r("execution_date")).alias("vt"), F.to_date("landed").alias("kt"), F.lit(0).alias("revision"),
        F.lit("split").alias("kind"), "r.split_from", "r.split_to", split_factor(F.lit(None).cast("double"), r("split_from"), r("split_to")).alias("ratio"), F.lit(run_id).alias("ingest_run_id"),
    )


def split_factor(ratio: Column, split_from: Column, split_to: Column) -> Column:
    return F.coalesce(ratio, F.try_divide(split_to, split_from))


def actions(dividends: DataFrame, splits: DataFrame) -> DataFrame:
    return dividends.unionByName(splits, allowMissingColumns=True)


def to_days(rows: DataFrame, run_id: str) -> DataFrame:
    """Times of records cut to days, and the run that brought them."""
    return rows.withColumns({"vt": F.to_date("vt"), "kt": F.to_date("kt"), "ingest_run_id": F.lit(run_id)})


def export_csv(rows: DataFrame, path: str) -> None:
    """An as-of extract as CSV: key, times, revision and close, empty where there is none."""
    rows.select("namespace", "instrument_id", "vt", "kt", "revision", F.coalesce(F.col("close").cast("string"), F.lit("")).alias("close")).write.option("header", True).option("emptyValue", "").csv(path)


def signals_from_json(raw: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """(strategy, seq, ret, turnover) from {"signals": {...}} or the bare object; strategies without signals have one empty row."""
    kind = "map<string,array<struct<return:double,turnover:double>>>"
    bare, wrapped = F.from_json(column, kind), F.from_json(column, f"struct<signals:{kind}>")["signals"]
    found = raw.select(F.coalesce(wrapped, bare).alias("m"))
    each = found.select("m", F.explode(F.array(*map(F.lit, names))).alias("strategy"))
    return each.select("strategy", F.posexplode_outer(F.try_element_at("m", F.col("strategy"))).alias("seq", "s")).select("strategy", "seq", F.col("s.return").alias("ret"), "s.turnover")


def file_digests(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, sha256) of whole files of less than 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str | Sequence[str], manifest: DataFrame) -> DataFrame:
    """(file, expected, sha256, matches) of a manifest (file: the name, expected: its digest); a file that isn't there doesn't match."""
    found = file_digests(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("file"), "sha256")
    return manifest.join(found.hint("merge"), "file", "left").withColumn("matches", F.coalesce(F.col("expected") == F.col("sha256"), F.lit(False)))


def read_artifacts(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Trial artifacts from lines of JSON, with ``violation`` for those that are no object."""
    read = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).filter("trim(value) <> ''").select(read.alias("a")).select("a.*")
    return rows.withColumn("violation", F.when(F.col("_bad").isNotNull(), "invalid JSON")).drop("_bad")


def append_lines(rows: DataFrame, path: str) -> None:
    """Audit lines (value), appended; what is there is never rewritten."""
    rows.select("value").write.mode("append").text(path)
