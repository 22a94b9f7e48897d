"""Landed record files as a stream: checked, deduplicated and appended.

Facts carry revisions, so a late row is one more revision and needs no repair;
only repeated arrivals of the same row are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bitemporal import KEY, violations


def record_stream(spark: SparkSession, path: str, schema, form: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def append_stream(rows: DataFrame, target: str, rejected: str, checkpoint: str, arrived: str = "arrived", delay: str = "7 days", once: bool = True) -> StreamingQuery:
    """Good rows to ``target`` by namespace, bad ones with their violations to ``rejected``.

    A row that arrives again within ``delay`` is dropped by its key and revision.
    Each batch has a folder of its own number, which a batch that is repeated
    after a failure writes anew: nothing is there twice.
    """
    first = rows.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([*KEY, "revision"]).withColumn("violations", violations(rows))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter(F.size("violations") == 0).drop("violations").write.mode("overwrite").partitionBy("namespace").parquet(f"{target}/batch={number}")
        batch.filter(F.size("violations") > 0).write.mode("overwrite").json(f"{rejected}/batch={number}")
        batch.unpersist()

    writer = first.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
