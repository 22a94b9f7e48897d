"""Labelled rows to learn from: a bounded sample, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``most`` labelled rows for which ``use`` holds.

    Of rows with the same id one is taken, and the larger label of an id counts.
    ``most`` ids bound what is broadcast.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & use)
    chosen = usable.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(most).withColumnRenamed(id_col, "_id")
    found = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))
    return found.groupBy(F.col("_id").alias("id"), "label").agg(F.max("text").alias("text")).select("id", "text", "label")
