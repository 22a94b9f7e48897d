"""What is known now, and every change of it, as records arrive.

A key's visible fact is kept as state.  A batch of records brings at most one
change a key: what was visible before it and what is visible after it.  Records that
arrive late, again, or under a revision that is not above the visible one change
nothing, so replays are harmless and the last change of each key, in whatever
order its records came, is what a batch read ``as_of`` of all of them shows.

State has a row a key and never expires, as any fact may be restated.  It is Parquet
beside the stream's progress: a whole copy each ``EVERY`` batches, and what each batch
since has changed.  A batch meets it in one grouping by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.bitemporal import KEY

#: The rank of a record without a revision, below all others.
NO_REVISION = -(2**31)
#: Batches after which the state is written whole.
EVERY = 16
#: A visible fact: what is compared, in this order.
_HELD = ("_revision", "_kt", "_fact")


def _visible() -> Column:
    return F.struct(*_HELD)


def _known(rows: DataFrame, values: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Records as (key, _revision, _kt, _fact); those without a knowledge time or a column of the key are left out."""
    json = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    whole = F.col("kt").isNotNull()
    for c in key:
        whole &= F.col(c).isNotNull()
    return rows.filter(whole).select(*key, F.coalesce("revision", F.lit(NO_REVISION)).cast("bigint").alias("_revision"), F.col("kt").alias("_kt"), json.alias("_fact"))


def _changed(rows: DataFrame, held: DataFrame | None, values: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, _revision, _kt, _fact, _old): the visible fact of each key whose one is new after ``rows``."""
    known = _known(rows, values, key).withColumn("_new", F.lit(True))
    both = known if held is None else known.unionByName(held.select(*key, *_HELD, F.lit(False).alias("_new")))
    best = both.groupBy(*key).agg(F.max(_visible()).alias("best"), F.max(F.when(~F.col("_new"), _visible())).alias("was"))
    return best.filter(F.col("was").isNull() | (F.col("was") < F.col("best"))).select(*key, "best.*", F.col("was._fact").alias("_old"))


def restatements(rows: DataFrame, held: DataFrame | None, values: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """(key, old, new, revision, kt) of a batch: a key's visible ``values`` before and after it, as structs; old is null at first sight.

    The highest revision is visible, of equal ones what was known last, then the
    greatest values as JSON.  ``held`` has (key, _revision, _kt, _fact) of what was visible at some time before, or is None.
    """
    return _told(_changed(rows, held, values, key), rows.schema, values, key)


def _told(changed: DataFrame, schema: StructType, values: Sequence[str], key: Sequence[str]) -> DataFrame:
    fact = StructType([schema[v] for v in values])
    revision = F.when(F.col("_revision") > NO_REVISION, F.col("_revision")).cast(schema["revision"].dataType)
    return changed.select(*key, F.from_json("_old", fact).alias("old"), F.from_json("_fact", fact).alias("new"), revision.alias("revision"), F.col("_kt").alias("kt"))


def restatement_stream(rows: DataFrame, values: Sequence[str], target: str, checkpoint: str, key: Sequence[str] = KEY, once: bool = True) -> StreamingQuery:
    """Changes to Parquet below ``target``, a folder for each batch, which a batch that is repeated after a failure writes anew.

    State is below ``checkpoint``.  Its folders are used in turn, none that the last ``EVERY`` batches
    rest on is written, so a batch may be repeated and no more than two whole copies are kept.
    """
    spark, key, schema = rows.sparkSession, list(key), rows.schema
    kinds = [*(schema[c] for c in key), StructField("_revision", LongType()), StructField("_kt", schema["kt"].dataType), StructField("_fact", StringType()), StructField("_old", StringType())]
    whole = lambda first: f"{checkpoint}/held/whole-{first // EVERY % 2}"
    delta = lambda number: f"{checkpoint}/held/delta-{number % (2 * EVERY)}"

    def read(*paths: str) -> DataFrame:
        return spark.read.schema(StructType(kinds)).parquet(*paths)

    def since(first: int, number: int) -> list[str]:
        return [*([whole(first)] if first else []), *map(delta, range(first, number))]

    def write(batch: DataFrame, number: int) -> None:
        first = number - number % EVERY
        if number and number == first:
            all_ = read(*since(first - EVERY, number)).groupBy(*key).agg(F.max(_visible()).alias("best"))
            all_.select(*key, "best.*").write.mode("overwrite").parquet(whole(first))
        before = since(first, number)
        _changed(batch, read(*before) if before else None, values, key).write.mode("overwrite").parquet(delta(number))
        _told(read(delta(number)), schema, values, key).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def standing(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The visible fact (key, values, revision, kt) of each key by the changes (with their ``batch``) that were written."""
    last = changes.groupBy(*key).agg(F.max_by(F.struct("new", "revision", "kt"), "batch").alias("x"))
    return last.select(*key, "x.new.*", "x.revision", "x.kt")
