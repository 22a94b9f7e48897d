"""Where the operators of this subpackage put what they write, and small common expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_own: dict[str, str] = {}
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Keys (an id and a hash) that are broadcast at most.
FEW_ROWS = 200_000
#: Spark's setting that deletes shuffle files at the end of the query that wrote them.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def map_batches(df: DataFrame, call, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors; a task's Arrow memory goes back when it ends.

    Texts are long rows: a session that has Spark's own batch of 10,000 rows gets
    ``BATCH_ROWS``, as JVM and Python both hold whole batches.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(partial(_released, call), schema)


def _released(call, batches):
    """The batches of ``call``; then what Arrow and the C library have kept goes back, as Spark keeps workers for later tasks."""
    yield from call(batches)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session may do without that setting, as tests do; it gets a
    temporary folder, one for each application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


class Scratch:
    """What an operator writes on its way: managed tables of a database in the shared folder.

    A written table cuts the lineage, survives lost executors and gives later
    joins true sizes to plan with.  The shuffle files behind it go when it is
    written, and the table goes with ``drop`` when what was made from it is
    written too.
    """

    def __init__(self, spark: SparkSession):
        self.spark, folder = spark, f"{shared_folder(spark)}/tidemark"
        self.database = f"tidemark_{zlib.crc32(folder.encode()):08x}"
        self.tables: dict[str, str] = {}
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{folder}'")

    def write(self, df: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 0) -> DataFrame:
        """The rows of ``df`` from a table; an earlier table of that name stays until it is dropped by ``drop``.

        With ``bucket_by`` a later grouping by that column moves no rows of the table.
        """
        table = f"{self.database}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEAN_SHUFFLES, "false")
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            writer = df.write.format("parquet")
            (writer.bucketBy(buckets, bucket_by) if bucket_by else writer).saveAsTable(table)
        finally:
            self.spark.conf.set(CLEAN_SHUFFLES, before)
        self.tables[table] = name
        return self.spark.table(table)

    def drop(self, *names: str, but: tuple[str, ...] = ()) -> None:
        """Delete the tables of these names, or all tables but those of the names in ``but``."""
        for table, name in list(self.tables.items()):
            if name in names or not names and name not in but:
                self.spark.sql(f"DROP TABLE {table}")
                del self.tables[table]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder."""
    return Scratch(df.sparkSession).write(df, name)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, text): rows known by their id and a hash of their text, as ids may be missing or be there twice."""
    text = F.col(text_col).cast("string")
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark")).alias("row_key"), text.alias("text"))


def without(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``found`` (id, mark), with all their columns.

    Up to ``FEW_ROWS`` keys are broadcast, so that no text is shuffled; more are
    met by a sort-merge join.
    """
    gone = written(found.select(F.col("id").alias("_id"), F.col("mark").alias("_mark")).distinct(), "gone")
    same = docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_mark"])
    return docs.join(gone.hint("broadcast" if gone.count() <= FEW_ROWS else "merge"), same, "left_anti")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))
