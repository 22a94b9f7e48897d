"""A growing store of bitemporal facts that is read as of a time without its history.

Facts are a table bucketed by their key and partitioned by the month in which
they became known.  A snapshot holds the visible fact of each key at one
knowledge time, bucketed alike.  A read at K takes the latest snapshot up to K and
the facts known since, whose months alone are scanned; as both are dealt to the
same buckets they meet without an exchange.  The next snapshot is made by such a
read, so it costs a snapshot and a tail whatever the length of the history.

Facts that arrive late, with a knowledge time that a snapshot covers, make that
snapshot and later ones stale, and ``append`` drops those.  Keys aren't null
(``bitemporal.quarantine`` holds such rows back).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitemporal import KEY, of_instruments

MONTH = "_known_in"


def _visible(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The highest revision of each key as a struct; of equal ones the one known last."""
    rest = [c for c in rows.columns if c not in (*key, "revision", "kt")]
    return rows.groupBy(*key).agg(F.max(F.struct("revision", "kt", *rest)).alias("_fact"))


class FactStore:
    """Tables ``{name}_facts`` and ``{name}_at_{time}``, in a database or at ``path``."""

    def __init__(self, spark: SparkSession, name: str, key: Sequence[str] = KEY, buckets: int = 24, path: str | None = None):
        self.spark, self.name, self.key, self.buckets, self.path = spark, name, list(key), buckets, path
        self.facts_table = f"{name}_facts"

    def _save(self, rows: DataFrame, table: str, mode: str, *partition: str) -> None:
        dealt = rows.repartition(self.buckets, *self.key)
        writer = dealt.write.format("parquet").bucketBy(self.buckets, *self.key).sortBy(*self.key).mode(mode)
        writer = writer.partitionBy(*partition) if partition else writer
        (writer.option("path", f"{self.path}/{table.split('.')[-1]}") if self.path else writer).saveAsTable(table)

    def facts(self) -> DataFrame:
        return self.spark.table(self.facts_table)

    def snapshots(self) -> list[str]:
        """The days of the snapshots that there are, the latest last."""
        database, _, plain = self.name.rpartition(".")
        found = self.spark.sql(f"SHOW TABLES {f'IN {database} ' if database else ''}LIKE '{plain}_at_*'").collect()
        return sorted(f"{m[1]}-{m[2]}-{m[3]}" for r in found if (m := re.fullmatch(rf"{re.escape(plain.lower())}_at_(\d{{4}})(\d\d)(\d\d)", r["tableName"])))

    def _table(self, day: str) -> str:
        return f"{self.name}_at_{day.replace('-', '')}"

    def append(self, rows: DataFrame) -> list[str]:
        """Add facts; the days of snapshots that they made stale, which are gone."""
        self._save(rows.withColumn(MONTH, F.date_format("kt", "yyyy-MM")), self.facts_table, "append", MONTH)
        earliest = rows.agg(F.min(F.to_date("kt")).cast("string")).first()[0]
        stale = [d for d in self.snapshots() if earliest is not None and d >= earliest]
        for d in stale:
            self.spark.sql(f"DROP TABLE {self._table(d)}")
        return stale

    def as_of(self, known_by: str, namespace: str | None = None, instruments=None, vt_start=None, vt_end=None) -> DataFrame:
        """The visible fact of each key on a day (yyyy-mm-dd), of the keys that are asked for."""

        def asked(rows: DataFrame) -> DataFrame:
            if namespace is not None:
                rows = rows.filter(F.col("namespace") == namespace)
            if vt_start is not None:
                rows = rows.filter(F.col("vt") >= vt_start)
            if vt_end is not None:
                rows = rows.filter(F.col("vt") <= vt_end)
            return of_instruments(rows, instruments)

        columns = [c for c in self.facts().columns if c != MONTH]
        base = max((d for d in self.snapshots() if d <= known_by), default=None)
        tail = self.facts().filter((F.to_date("kt") <= F.lit(known_by).cast("date")) & (F.col(MONTH) <= known_by[:7]))
        if base is None:
            found = _visible(asked(tail).select(columns), self.key)
        else:
            tail = tail.filter((F.to_date("kt") > F.lit(base).cast("date")) & (F.col(MONTH) >= base[:7]))
            later = _visible(asked(tail).select(columns), self.key)
            rest = [c for c in columns if c not in (*self.key, "revision", "kt")]
            held = asked(self.spark.table(self._table(base))).select(*self.key, F.struct("revision", "kt", *rest).alias("_held"))
            found = held.hint("merge").join(later, self.key, "full").withColumn("_fact", F.greatest("_held", "_fact"))
        return found.select(*(c if c in self.key else F.col(f"_fact.{c}").alias(c) for c in columns))

    def compact(self, day: str) -> None:
        """Keep what is visible on a day as a snapshot, made of the one before and the facts since."""
        if day not in self.snapshots():
            self._save(self.as_of(day), self._table(day), "errorifexists")

    def drop(self) -> None:
        for table in [*map(self._table, self.snapshots()), self.facts_table]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
