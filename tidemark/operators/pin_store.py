"""Pins of a store that grows, without hashing again what is pinned already.

``{name}_digests`` holds the digest of every row and ``{name}_nodes`` the digests of
its buckets, both by the batch that brought them and bucketed by the digests'
prefix.  A batch adds its own rows' digests, and nodes of those buckets only
that it touched; a bucket's node is its latest one.  A pin reads nodes alone,
16 ** ``prefix`` a batch at most, and equals ``snapshot_pin`` of all rows of the
batches up to any that is asked for.

A batch has a number from its caller, later ones greater.  One that is pinned
already is passed over, and what a failed one left is written anew, so
an append may be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pins import bucket_nodes, pin_of_nodes, row_digest

#: Up to so many touched buckets are named in the read of their digests, which then opens only the files that may hold them.
NAMED = 1000


class PinStore:
    """Tables in a database (``name`` may have it in front) or at ``path``; ``columns`` and ``prefix`` are part of what its pins mean."""

    def __init__(self, spark: SparkSession, name: str, columns: Sequence[str] | None = None, prefix: int = 5, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.columns, self.prefix, self.buckets, self.path = spark, name, columns, prefix, buckets, path
        self.digests_table, self.nodes_table = f"{name}_digests", f"{name}_nodes"

    def _save(self, rows: DataFrame, table: str, batch: int) -> None:
        """The rows as all that there is of a batch, whatever a failed append left of it."""
        dealt = rows.repartition(self.buckets, "b")
        if not self.spark.catalog.tableExists(table):
            writer = dealt.limit(0).withColumn("batch", F.lit(batch).cast("bigint")).write.format("parquet").bucketBy(self.buckets, "b").sortBy("b").partitionBy("batch")
            (writer.option("path", f"{self.path}/{table.split('.')[-1]}") if self.path else writer).saveAsTable(table)
        self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = {int(batch)}) SELECT {', '.join(rows.columns)} FROM {{dealt}}", dealt=dealt)

    def batches(self) -> list[int]:
        """The numbers of the batches that are pinned."""
        if not self.spark.catalog.tableExists(self.nodes_table):
            return []
        return sorted(int(r["partition"].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.nodes_table}").collect())

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Pin more rows; false if the batch is pinned already.  Nothing is read of earlier rows but digests of touched buckets."""
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        d = rows.select(row_digest(rows, self.columns).alias("d"))
        self._save(d.select(F.substring("d", 1, self.prefix).alias("b"), "d"), self.digests_table, batch)
        held = self.spark.table(self.digests_table)
        own = held.filter(F.col("batch") == batch).select("b").distinct()
        some = [r["b"] for r in own.limit(NAMED + 1).collect()]
        earlier = held.filter(F.col("batch").isin([*done, batch]))
        touched = earlier.filter(F.col("b").isin(some)) if len(some) <= NAMED else earlier.join(own.hint("merge"), "b", "left_semi")
        self._save(bucket_nodes(touched), self.nodes_table, batch)
        return True

    def nodes(self, batch: int | None = None) -> DataFrame:
        """(b, d, n) of every bucket as it was after a batch, the last one if none is named."""
        rows = self.spark.table(self.nodes_table)
        rows = rows if batch is None else rows.filter(F.col("batch") <= batch)
        return rows.groupBy("b").agg(F.max(F.struct("batch", "d", "n")).alias("x")).select("b", "x.d", "x.n")

    def pin(self, batch: int | None = None) -> DataFrame:
        """One row (pin, n), as ``snapshot_pin`` of all rows up to a batch."""
        return pin_of_nodes(self.nodes(batch))

    def changed(self, before: int, after: int) -> DataFrame:
        """(b, n_before, n_after) of the buckets whose rows differ between two batches."""
        old, new = self.nodes(before).select("b", F.col("d").alias("_d"), F.col("n").alias("n_before")), self.nodes(after)
        met = new.hint("merge").join(old, "b", "left").filter(~F.col("d").eqNullSafe(F.col("_d")))
        return met.select("b", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.col("n").alias("n_after"))

    def drop(self) -> None:
        for table in (self.nodes_table, self.digests_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
