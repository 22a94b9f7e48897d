"""Benchmark passages inside documents: size-partitioned MinHash containment search, then exact shingles.

A test item is short and a document may be very long, so their similarity says
little; what counts is the share of the item's word shingles that the document
holds.  Items are partitioned by their number of shingles.  An item is sketched
by its smallest shingle hashes, and a partition's items of up to ``m`` shingles
keep ``m - ceil(t * m) + 1`` of them: a document that holds a share ``t`` of an
item lacks fewer, so it holds at least one hash of the sketch and the search
misses nothing.  A partition is only searched in documents that have enough
shingles.  Documents that hold a hash of a sketch are then held against the
items by the shingles themselves.

All of it is DataFrame functions: shingles are hashed inside the scan, and only
the few documents that hold a sketch's hash are taken apart into rows.  The
sketches go into the scan as a literal while they are under ``INLINE``
hashes, which is counted first; larger ones are found by a shuffled join.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]`` with A-Z in lower case.

Defined cases: a null text is an empty text and has no shingle; a text with
fewer than ``n`` words has its whole sequence as one shingle; an item without
words is never found; repeated items and repeated documents give one row for
each pair of ids, with the largest overlap; null ids are kept as an id of their
own; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import keyed, whole_text, without, written

#: Hashes up to which the sketches are a literal of the scan, and shingles up to which the items are broadcast.
INLINE, SMALL = 20_000, 200_000


def words_of(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(words: Column, n: int, each) -> Column:
    """``each`` of every run of ``n`` words; of the whole sequence if it is shorter; nothing if it is empty."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: each(F.slice(words, i, n)))).otherwise(F.array())


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once however often it is used: a generator of one row, which no optimiser rule inlines."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def item_shingles(items: DataFrame, n: int, num: int, den: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, shingle, hash, n_item, part, least, sketch) of every distinct shingle of every item."""
    own = items.select(F.col(id_col).alias("item_id"), F.xxhash64(whole_text(text_col)).alias("of"), words_of(whole_text(text_col)).alias("words")).dropDuplicates(["item_id", "of"])
    all_ = own.select("item_id", "of", F.array_distinct(_runs(F.col("words"), n, lambda w: F.concat_ws(" ", w))).alias("found")).filter(F.size("found") > 0)
    part = F.floor(F.log2(F.size("found"))).cast("int")
    most = F.pow(F.lit(2), part + 1).cast("bigint") - 1
    keep = most - F.ceil(most * F.lit(num) / F.lit(den)) + 1
    least = F.ceil(F.pow(F.lit(2), part) * F.lit(num) / F.lit(den)).cast("bigint")
    hashes = F.array_sort(F.transform("found", lambda s: F.xxhash64(F.split(s, " "))))
    all_ = all_.select("item_id", "of", "found", F.size("found").cast("bigint").alias("n_item"), part.alias("part"), least.alias("least"), F.slice(hashes, F.lit(1), keep.cast("int")).alias("smallest"))
    rows = all_.select("item_id", "of", "n_item", "part", "least", "smallest", F.explode("found").alias("shingle"))
    return rows.select("item_id", "of", "n_item", "part", "least", "shingle", F.array_contains("smallest", F.xxhash64(F.split("shingle", " "))).alias("sketch"))


def find(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, n_item, n_shared, containment) of every document that holds a share num / den of an item."""
    known = written(item_shingles(items, n, num, den), "items")
    sketch = known.filter("sketch").select("part", "least", F.xxhash64(F.split("shingle", " ")).alias("hash")).distinct()
    size = known.agg(F.count(F.lit(1)).alias("all"), F.count_if("sketch").alias("sketched")).first()

    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    own = _once(texts, "words", words_of(F.col("text"))).select("id", "words")
    own = _once(own, "hashes", _runs(F.col("words"), n, lambda w: F.xxhash64(w)))
    if size["sketched"] <= INLINE:
        hit = F.lit(False)
        for row in sketch.groupBy("part").agg(F.min("least").alias("least"), F.collect_list("hash").alias("hashes")).collect():
            hit |= (F.size("hashes") >= F.lit(row["least"])) & F.arrays_overlap("hashes", F.array(*map(F.lit, row["hashes"])))
        held = own.filter(hit).select("id", "words")
    else:
        keyed = own.withColumn("row", F.xxhash64("id", "words"))
        near = keyed.select("row", F.size("hashes").alias("n"), F.explode("hashes").alias("hash")).join(sketch.hint("shuffle_hash"), "hash").filter("n >= least").select("row").distinct()
        held = keyed.join(near.hint("merge"), "row", "left_semi").select("id", "words")
    held = held.select("id", F.xxhash64("words").alias("row"), F.explode(F.array_distinct(_runs(F.col("words"), n, lambda w: F.concat_ws(" ", w)))).alias("shingle"))
    wanted = known.select("item_id", "of", "n_item", "shingle")
    met = held.join(F.broadcast(wanted) if size["all"] <= SMALL else wanted.hint("merge"), "shingle")
    shared = met.groupBy("id", "row", "item_id", "of", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    best = shared.filter(F.col("n_shared") * F.lit(den) >= F.col("n_item") * F.lit(num)).groupBy("id", "item_id").agg(F.max_by(F.struct("n_item", "n_shared"), F.struct("n_shared", "n_item")).alias("m"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("m.n_item").alias("n_item"), F.col("m.n_shared").alias("n_shared"), (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def remove(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows are told apart by id and text."""
    found = find(keyed(docs, id_col, text_col), items, n, num, den, "row_key", "text")
    return without(docs, found.select("row_key.id", "row_key.mark"), id_col, text_col)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Any query text over `documents` and `benchmark` that has words of both can use it; words are joined by one blank.
_SHINGLES = r"""
  SELECT {id}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM (SELECT {id}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table})
"""


def containment_sql(table: str) -> str:
    return f"""
  SELECT d.doc_id, i.item_id, any_value(c.n_item) AS n_item, count(*) AS n_shared, count(*) / any_value(c.n_item)::DOUBLE AS containment
  FROM ({_SHINGLES.format(id="doc_id", table=table)}) d JOIN ({_SHINGLES.format(id="item_id", table="benchmark")}) i USING (s)
  JOIN (SELECT item_id, count(*) AS n_item FROM ({_SHINGLES.format(id="item_id", table="benchmark")}) GROUP BY item_id) c USING (item_id)
  GROUP BY d.doc_id, i.item_id HAVING count(*) * 100 >= any_value(c.n_item) * 80
"""


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL = {"op5_decontaminate": containment_sql("documents")}
