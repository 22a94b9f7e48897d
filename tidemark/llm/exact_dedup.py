"""Exact dedup against a persistent digest index.

The index is a table with one row for each distinct text: its digest, the id
that stays and the number of copies seen, bucketed and sorted by digest.  New
rows are first reduced to one row for each digest by a partial aggregate, and
those are written, as Spark would else move the anti-join below the aggregate
and shuffle every copy: a text that makes up a third of all rows costs no more
than any other.  They are then found new or known by a sort-merge anti-join, for which the
index isn't exchanged (nor sorted, until a second batch gives a bucket a second file), and appended.

Texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  Of equal texts in one batch the row with the most code
points in its original text stays, then the smallest id.  A text that an
earlier batch brought is a copy of the id that stayed then.

Defined cases: a null text is an empty text, and all texts of white space only
are equal to it; a null id ranks after every other id; repeated rows are copies
of one another, and ``kept`` is true on every row that carries the id that
stays, where ``keep_one`` returns just one of them; texts of any length are
digested whole; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, whole_text

#: Texts with more copies than this share of the rows are joined by broadcast: there are fewer than 1 / HOT_SHARE.
HOT_SHARE = 1 / 2000
#: Digests of a bucket of the index.
BUCKET_ROWS = 4_000_000
#: The characters that make no difference.
WHITE = " \t\n\x0b\x0c\r"


def buckets_for(n_rows: int) -> int:
    """A bucket for every BUCKET_ROWS digests, 24 at least."""
    return max(24, -(-n_rows // BUCKET_ROWS))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, code points of the original text) of every row."""
    text = whole_text(text_col)
    bare = F.translate(text, WHITE, "")
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(bare, 256)).alias("digest"), F.length(text).alias("n_points"))


def groups(marks: DataFrame) -> DataFrame:
    """One row for each digest: the id that stays and the number of rows."""
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id")))
    return marks.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).select("digest", F.col("best.id").alias("keep_id"), F.col("copies"))


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far.

    It is a table of that name, in the catalog's folder or at ``path``; without a
    name it is one in the operators' own database, which ``drop`` deletes.
    The number of buckets is fixed when the table is made, by the rows that it
    is made for; ``rebucket`` makes the table anew for more.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"{Scratch(spark).database}.digest_index_{uuid.uuid4().hex}"
        self.path = path

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _save(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode(mode).format("parquet")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def open(self, kind: str, n_rows: int) -> None:
        """Make the table if there is none, empty, for about ``n_rows`` rows whose ids are of type ``kind``."""
        if not self.exists():
            self.buckets = self.buckets or buckets_for(n_rows)
            self._save(self.spark.createDataFrame([], f"digest binary, keep_id {kind}, copies bigint"), "errorifexists")
        elif not self.buckets:
            about = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()}
            self.buckets = int(about["Num Buckets"])

    def unknown(self, found: DataFrame) -> DataFrame:
        """Those groups whose digest the index doesn't have, by a sort-merge anti-join; ``found`` is read from a table."""
        return found.join(self.rows().hint("merge").select("digest"), "digest", "left_anti")

    def add(self, found: DataFrame) -> None:
        """Append those groups whose digest the index doesn't have."""
        self._save(self.unknown(found), "append")

    def rebucket(self, buckets: int) -> DigestIndex:
        """The same digests in a new table with another number of buckets; this one stays."""
        other = DigestIndex(self.spark, buckets=buckets)
        other._save(self.rows(), "errorifexists")
        return other

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def mark(self, marks: DataFrame) -> DataFrame:
        """Each row of ``marks`` with the id that stays for its digest and the copies the index counted.

        The few digests with very many copies are looked up by broadcast (their
        number is bounded by 1 / HOT_SHARE), all others by a sort-merge join.
        """
        known = self.rows()
        least = F.greatest(F.lit(1000), F.ceil(F.lit(HOT_SHARE) * F.lit(known.agg(F.sum("copies")).first()[0] or 0)))
        hot = known.filter(F.col("copies") > least)
        often = marks.join(F.broadcast(hot), "digest")
        rest = marks.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        return often.unionByName(rest.join(known.filter(F.col("copies") <= least).hint("merge"), "digest"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's (id, keep_id, group_size, kept, text_sha256); the batch is added to ``index``.

    ``group_size`` counts the rows of the batch in which the text was first
    seen.  ``kept`` is true where the id is the one that stays.
    """
    one_off = index is None
    index = index or DigestIndex(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    marks = scratch.write(digests(docs, id_col, text_col), "marks")
    before = index.exists()
    index.open(dict(marks.dtypes)["id"], marks.count())
    found = scratch.write(groups(marks), "groups")
    if before:
        found = scratch.write(index.unknown(found), "fresh")
    index.add(found)
    out = index.mark(marks)
    if before:
        out = out.join(found.select("digest", F.lit(True).alias("new")).hint("merge"), "digest", "left")
    fresh = F.col("new").isNotNull() if before else F.lit(True)
    out = out.select(F.col("id").alias(id_col), "keep_id", F.col("copies").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep_id")) & fresh).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if one_off:  # nobody has a name for the index, so it goes when the verdicts are written
        out = scratch.write(out, "verdicts")
        index.drop()
        scratch.drop("marks", "groups")
    return out


def keep_one(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are matched by id and digest.  Where several rows agree in both, the
    one with the most code points stays, then the first in the order of the
    original text, so exactly one row of each group is returned.
    """
    key = lambda i, d: F.concat_ws(" ", d, F.coalesce(i.cast("string"), F.lit("")))
    verdict = dedup(docs, index, id_col, text_col).filter("kept").select(key(F.col(id_col), F.col("text_sha256")).alias("_key")).distinct()
    text = whole_text(text_col)
    own = docs.withColumns({"_key": key(F.col(id_col), F.sha2(F.translate(text, WHITE, ""), 256)), "_points": F.length(text)})
    mine = own.join(verdict.hint("merge"), "_key", "left_semi")
    order = Window.partitionBy("_key").orderBy(F.desc("_points"), text)
    return mine.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
