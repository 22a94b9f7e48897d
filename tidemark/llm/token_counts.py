"""Token counts of documents in flat token files that have no index.

A token file is unsigned 16-bit little-endian numbers: token id + 1, and 0 at
the end of each document.  Counting them is a scan for the separators: a task
finds those of each block of a file at once, and as documents run over the
edges of blocks, a prefix scan over the blocks of a file (how many documents
ended before, where the last of them ended) places every document's first part.

Files are written by Spark's text writer with the separator as line end.  A line
is a piece of some documents with separators between them, so its bytes are the
file's bytes.  A reader takes a file as one value, so a task of the writer begins
a new file after FILE_PIECES pieces; a piece holds PIECE_BYTES of text, or one
document that is longer, and so a file's size doesn't follow the input's.

Defined cases: a null or empty text is a separator alone, of 0 tokens; tokens
after a file's last separator are a document that isn't ended; an empty file
has no documents; repeated rows are counted each for itself; a null id stays
null; further columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import map_batches, new_path
from ._tokens import Encoder, vocabulary_path

#: Numbers of a file that are scanned at once, and pieces of documents in a file.
BLOCK, FILE_PIECES = 1 << 20, 16


def _lines(batches, vocabulary: str):
    encoder = Encoder(vocabulary)
    for batch in batches:
        for _, ids, of_text in encoder.batches(batch.column(0), None):
            if len(ids) and ids.max() > 65534:
                raise ValueError("a token id is over 65534; 16 bits don't hold it")
            raw = np.insert((ids + 1).astype("<u2"), of_text[1:-1], 0).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["line"])


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, text_col: str = "text") -> None:
    """Flat files of FILE_PIECES pieces for each partition of ``docs``, in the order of its rows."""
    lines = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), partial(_lines, vocabulary=vocabulary or vocabulary_path()), "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\0\0").option("maxRecordsPerFile", FILE_PIECES).text(path)


def _blocks(batches, block: int):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            flat = np.frombuffer(content.as_buffer(), "<u2")
            rows = [(k, min(block, len(flat) - at), np.flatnonzero(flat[at : at + block] == 0)) for k, at in enumerate(range(0, len(flat), block))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(rows), pa.string()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2].astype(np.int32) for x in rows], pa.list_(pa.int32()))],
                ["file", "block", "n", "ends"],
            )


def scan(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document of every file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    blocks = map_batches(files, partial(_blocks, block=block), "file string, block bigint, n bigint, ends array<int>")
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("block") * F.lit(block)
    blocks = blocks.withColumn("last_end", F.when(F.size("ends") > 0, base + F.element_at("ends", -1)))
    placed = blocks.select(
        "file", "n", "ends", base.alias("base"),
        F.coalesce(F.sum(F.size("ends")).over(so_far), F.lit(0)).alias("before"),
        F.coalesce(F.max("last_end").over(so_far), F.lit(-1)).alias("carry"),
        F.lead("block").over(order).isNull().alias("final"),
    )
    ended = placed.select("file", "base", "before", "carry", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("carry") + 1).otherwise(F.col("base") + F.get("ends", F.col("k") - 1) + 1)
    ended = ended.select("file", (F.col("before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1) + 1).otherwise(F.col("carry") + 1)
    rest = placed.filter("final").select("file", (F.col("before") + F.size("ends")).alias("ordinal"), tail.alias("start"), (F.col("base") + F.col("n") - tail).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest.filter("n_tokens > 0"))


def _place_of(file: Column) -> list[Column]:
    """The task and its file's number by a path that ends in part-<task>-<uuid>-c<number>.<ending>; a UUID may hold -c and digits too."""
    name = F.element_at(F.split(file, "/"), -1)
    return [F.regexp_extract(name, pattern, 1).cast("bigint") for pattern in (r"^part-(\d+)", r"-c(\d+)\.[^-]*$")]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row of ``docs``, a table that is read from files: written as token files, then scanned.

    The documents of a task's files, in order, are the rows of the task's partition,
    which both reads of an unchanged table deal out alike; that the numbers of
    rows and documents agree in every partition is checked.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, text_col)
    part, number = _place_of(F.col("file"))
    of_part = Window.partitionBy("part").orderBy("number", "ordinal")
    counts = scan(spark, path, block).select(part.alias("part"), number.alias("number"), "ordinal", "n_tokens")
    counts = counts.select("part", (F.row_number().over(of_part) - 1).cast("bigint").alias("row"), "n_tokens")
    at = F.monotonically_increasing_id()
    ids = docs.select(F.col(id_col).alias("id"), at.alias("at")).select("id", F.shiftrightunsigned("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    met = counts.withColumn("met", F.lit(True)).hint("merge").join(ids.withColumn("row_met", F.lit(True)), ["part", "row"], "full")
    checked = F.when(F.col("met").isNull() | F.col("row_met").isNull(), F.raise_error(F.lit("rows and documents of the token files don't agree"))).otherwise(F.col("n_tokens"))
    return met.select(F.col("id").alias(id_col), checked.cast("bigint").alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_token_counts": op10_token_counts}
#: Token ids are not SQL's; tests hold the counts against the tokenizer's.
ORACLE_SQL: dict[str, str] = {}
