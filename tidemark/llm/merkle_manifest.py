"""A Merkle manifest of a corpus: a tree for each language over its documents in order, and a tree over the languages.

A leaf is the hash of a document's fields; every ``ARITY`` consecutive nodes
have the hash of theirs as parent (the last run has what is left, even one node)
until one node remains.  Documents are ranked within their language by one
range sort, and a rank is a block's number and ``DIGITS`` digits within it.  A
block is a hash of its digits grouped away, the last first: each grouping nests
its child structs in the parent's, and as all of them keep the block they were
dealt by, they share one exchange.  A block's root is a leaf of the next tier, whose
ranks are the blocks' numbers, up to one node for each language; the languages'
roots are ranked and nested the same way.

Proofs come down the tiers: a nested block meets the path above it in a grouping
by block (not a join: a null language is a key like any other), transforms walk
down its levels adding to each child's path what stands left and right of it, and
one explode gives the block's leaves.  A block has at most ARITY ** DIGITS leaves,
so no row and no task holds a language, however many documents it has.

Defined cases: a null field is hashed as ``-`` and differs from an empty one; a
null language is the first one; null ids come first in their language; rows with
the same id are ordered by their leaf's hash; repeated rows are leaves of their own;
texts of any length are hashed whole; further columns are not read; a lone leaf
is its language's root, whose proof there is empty; an empty table has no rows
and no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import FEW_ROWS, Scratch

#: Nodes that share a parent, and levels of a block.
ARITY, DIGITS = 2, 6
#: What a leaf is the hash of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def part_of(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its number of bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(part_of, fields)), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``rank`` from 0 and ``total`` of their group in ``order``.

    The rows are sorted by ranges, so a group may lie over many tasks; ranks come
    from a count for each group and range.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    sorted_ = rows.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    placed = scratch.write(sorted_.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    sizes = placed.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    of = Window.partitionBy(group)  # a row for each range
    before = F.sum("_n").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.withColumns({"_skip": F.coalesce(before, F.lit(0)) - F.col("_first"), "total": F.sum("_n").over(of)}).select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_skip", "total")
    offset = scratch.write(offset, f"{name}_offsets")
    hint = "broadcast" if offset.count() <= FEW_ROWS else "merge"
    met = placed.join(offset.hint(hint), placed[group].eqNullSafe(offset["_g"]) & (placed["_range"] == offset["_r"]))
    return met.withColumn("rank", F.col("_at") + F.col("_skip")).drop("_g", "_r", "_range", "_at", "_skip")


def height_of(total: Column, arity: int) -> Column:
    """Levels above ``total`` leaves until one node remains."""
    powers, n = [], 1
    while n < 1 << 62:
        powers.append(n)
        n *= arity
    return F.size(F.filter(F.array(*(F.lit(p).cast("bigint") for p in powers)), lambda p: p < total))


def nest(nodes: DataFrame, level: int, arity: int, digits: int) -> DataFrame:
    """(grp, height, block, node) of ``nodes`` (grp, height, rank, node): the nested struct of each block of arity ** digits ranks.

    ``level`` is the nodes' level in their tree; a level at or above a tree's
    height hands its one node on.
    """
    size = arity**digits
    digit = {f"d{k}": F.pmod(F.floor(F.col("rank") / arity**k), F.lit(arity)).cast("int") for k in range(digits)}
    rows = nodes.withColumn("block", F.floor(F.col("rank") / size)).withColumns(digit).select("grp", "height", "block", *digit, "node")
    for k in range(digits):
        keep = ["grp", "height", "block", *(f"d{j}" for j in range(k + 1, digits))]
        kids = rows.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), F.col("node").alias("n")))).alias("kids"))
        kids = kids.withColumn("kids", F.transform("kids", lambda kid: kid["n"]))
        own = F.when(F.col("height") > level + k, F.sha2(F.concat_ws("", F.transform("kids", lambda kid: kid["h"])), 256)).otherwise(F.get("kids", F.lit(0))["h"])
        rows = kids.select(*keep, F.struct(own.alias("h"), F.col("kids")).alias("node"))
    return rows


def unnest(blocks: DataFrame, level: int, arity: int, digits: int) -> DataFrame:
    """(grp, rank, node, path, top) of the leaves of ``blocks`` (grp, height, block, node, path, top).

    ``path`` is an array of what stands left and right of a node, from its own
    level to the top.
    """
    size = arity**digits
    spread = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), F.col("node").alias("node"), F.col("path").alias("path")))

    def down(k: int):
        def children(parent: Column) -> Column:
            kids = parent["node"]["kids"]

            def child(kid: Column, j: Column) -> Column:
                hashes = lambda begin, n: F.concat_ws("", F.transform(F.slice(kids, begin, n), lambda x: x["h"]))
                beside = F.struct(hashes(F.lit(1), j).alias("left"), hashes(j + 2, F.size(kids)).alias("right"))
                path = F.when(F.col("height") > level + k, F.concat(F.array(beside), parent["path"])).otherwise(parent["path"])
                return F.struct((parent["at"] * arity + j).alias("at"), kid.alias("node"), path.alias("path"))

            return F.transform(kids, child)

        return children

    for k in reversed(range(digits)):
        spread = F.flatten(F.transform(spread, down(k)))
    out = blocks.select("grp", "block", "top", F.explode(spread).alias("leaf"))
    return out.select("grp", (F.col("block") * size + F.col("leaf.at")).alias("rank"), F.col("leaf.node").alias("node"), F.col("leaf.path").alias("path"), "top")


PATH = "array<struct<left:string,right:string>>"


class Tree:
    """The tiers of nested blocks over nodes (grp, rank, total, node), where node is a struct with a hash ``h``."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, name: str, arity: int = ARITY, digits: int = DIGITS):
        self.scratch, self.name, self.arity, self.digits = scratch, name, arity, digits
        self.tiers: list[DataFrame] = []
        rows = nodes.withColumn("height", height_of(F.col("total"), arity)).select("grp", "height", "rank", "node")
        while True:
            tier = scratch.write(nest(rows, len(self.tiers) * digits, arity, digits), f"{name}_tier{len(self.tiers)}")
            self.tiers.append(tier)
            if not tier.filter("block > 0").limit(1).count():
                break
            rows = tier.select("grp", "height", F.col("block").alias("rank"), F.struct(F.col("node.h").alias("h")).alias("node"))

    def roots(self) -> DataFrame:
        """(grp, root)."""
        return self.tiers[-1].select("grp", F.col("node.h").alias("root"))

    def paths(self, above: DataFrame) -> DataFrame:
        """(grp, rank, node, path, top) of every node; ``above`` (grp, path, top) has what stands above each group's root, and more that its nodes shall carry."""
        upper = above.withColumn("rank", F.lit(0).cast("bigint"))
        for level, tier in reversed([*enumerate(self.tiers)]):
            upper = unnest(self._met(tier, upper), level * self.digits, self.arity, self.digits)
        return upper

    def _met(self, tier: DataFrame, upper: DataFrame) -> DataFrame:
        """Blocks of a tier with the path above each."""
        there = tier.select("grp", "block", "height", "node")
        over = upper.select("grp", F.col("rank").alias("block"), "path", "top")
        both = there.unionByName(over, allowMissingColumns=True).groupBy("grp", "block")
        return both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("height", "node", "path", "top")))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", arity: int = ARITY, digits: int = DIGITS, scratch: Scratch | None = None) -> DataFrame:
    """(id, leaf, tampered, subroot, root, path) of every row.

    ``tampered`` is the hash that a row has now, where it isn't the one that the
    manifest is made of, or null.
    """
    own = scratch or Scratch(docs.sparkSession)
    changed = F.lit(None).cast("string") if tampered is None else tampered
    leaves = docs.select(F.col(group).alias("grp"), F.col(key).alias("id"), leaf_of([F.col(c) for c in fields]).alias("h"), changed.alias("tampered"))
    # numbered as they are written, so that even equal rows are parted by the range sort
    leaves = own.write(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = ranked(leaves, "grp", ["id", "h", "tie"], own, "placed")
    by_group = Tree(placed.select("grp", "rank", "total", F.struct("h", "id", "tampered").alias("node")), own, "docs", arity, digits)
    roots = by_group.roots().select(F.lit(0).alias("one"), F.col("grp").alias("name"), F.col("root").alias("h"))
    tops = ranked(roots, "one", ["name"], own, "tops")
    whole = Tree(tops.select(F.col("one").alias("grp"), "rank", "total", F.struct("h", "name").alias("node")), own, "top", arity, digits)
    root = whole.roots().select("grp", F.array().cast(PATH).alias("path"), F.col("root").alias("top"))
    above = whole.paths(root).select(F.col("node.name").alias("grp"), "path", F.struct(F.col("node.h").alias("subroot"), F.col("top").alias("root")).alias("top"))
    found = by_group.paths(own.write(above, "above"))
    return found.select(F.col("node.id").alias("id"), F.col("node.h").alias("leaf"), F.col("node.tampered").alias("tampered"), "top.subroot", "top.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda h, beside: F.sha2(F.concat(beside["left"], h, beside["right"]), 256))


def siblings(path: Column) -> Column:
    """A proof's hashes from its leaf to the root, left to right, as one text."""
    return F.concat_ws("", F.transform(path, lambda beside: F.concat(beside["left"], beside["right"])))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    scratch = Scratch(spark)
    found = manifest(docs, F.when(drawn & F.col("n_chars").isNotNull(), more), scratch=scratch)
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    out = scratch.write(out.select("*", (F.col("folded_root") == F.col("root")).alias("verified")), "manifest")
    scratch.drop(but=("manifest",))
    return out


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_UP = "list_transform(range(0, (len(l) + 1) // 2), lambda k: sha256(l[2 * k + 1] || coalesce(l[2 * k + 2], '')))"
ORACLE_SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(list_concat([b::UBIGINT], range(0, 8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
), d AS (
  SELECT documents.*, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS other,
    xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS crc
  FROM documents, crc
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS now, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), up AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY i) AS l FROM leaves GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, {_UP} FROM up WHERE len(l) > 1
), subs AS (SELECT lang, lvl AS height, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM up WHERE len(l) = 1),
top AS (
  SELECT 0 AS lvl, list(subroot ORDER BY i) AS l FROM subs
  UNION ALL SELECT lvl + 1, {_UP} FROM top WHERE len(l) > 1
), steps AS (
  SELECT x.lang, x.i, lvl, CASE WHEN (x.i >> lvl) & 1 = 1 THEN l[(x.i >> lvl)] ELSE '' END AS a, CASE WHEN (x.i >> lvl) & 1 = 0 THEN coalesce(l[(x.i >> lvl) + 2], '') ELSE '' END AS b
  FROM leaves x JOIN up ON x.lang IS NOT DISTINCT FROM up.lang AND len(l) > 1
  UNION ALL
  SELECT x.lang, x.i, s.height + lvl, CASE WHEN (s.i >> lvl) & 1 = 1 THEN l[(s.i >> lvl)] ELSE '' END, CASE WHEN (s.i >> lvl) & 1 = 0 THEN coalesce(l[(s.i >> lvl) + 2], '') ELSE '' END
  FROM leaves x JOIN subs s ON x.lang IS NOT DISTINCT FROM s.lang JOIN top ON len(l) > 1
), fold AS (
  SELECT lang, i, 0 AS lvl, now AS h FROM leaves
  UNION ALL SELECT f.lang, f.i, f.lvl + 1, sha256(s.a || f.h || s.b) FROM fold f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.i = s.i AND f.lvl = s.lvl
), last AS (SELECT lang, i, arg_max(h, lvl) AS folded_root FROM fold GROUP BY ALL),
proof AS (SELECT lang, i, string_agg(a || b, '' ORDER BY lvl) AS p FROM steps GROUP BY ALL)
SELECT x.doc_id, x.leaf, s.subroot, r.l[1] AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = r.l[1] AS verified
FROM leaves x JOIN subs s ON x.lang IS NOT DISTINCT FROM s.lang JOIN top r ON len(r.l) = 1 JOIN last f ON f.lang IS NOT DISTINCT FROM x.lang AND f.i = x.i
LEFT JOIN proof ON proof.lang IS NOT DISTINCT FROM x.lang AND proof.i = x.i
"""
}
