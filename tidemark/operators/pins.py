"""Content hashes: rows, snapshots and Merkle roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(rows: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row as JSON with its columns in alphabetical order, nulls kept as such."""
    return F.to_json(F.struct(*sorted(columns or rows.columns)), {"ignoreNullFields": "false"})


def row_digest(rows: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(canonical(rows, columns), 256)


def snapshot_pin(rows: DataFrame, columns: Sequence[str] | None = None, prefix: int = 5) -> DataFrame:
    """One row (pin, n): a digest of all rows, the same in whatever order they come.

    Rows are digested, digests are dealt to buckets by their first bytes and
    sorted within, a bucket's digest is that of its digests, and the pin that of
    the buckets in order.  There are 16 ** ``prefix`` buckets at most, whatever
    the number of rows: ``prefix`` is part of what a pin means, so rows are
    pinned and verified with the same one.  With 5, a bucket of 10^9 rows holds
    a thousand digests.
    """
    digests = rows.select(row_digest(rows, columns).alias("d"))
    return pin_of_nodes(bucket_nodes(digests.withColumn("b", F.substring("d", 1, prefix))))


def bucket_nodes(digests: DataFrame) -> DataFrame:
    """(b, d, n): the digest and number of each bucket's digests ``d``."""
    return digests.groupBy("b").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("d"))), 256).alias("d"), F.count(F.lit(1)).alias("n"))


def pin_of_nodes(nodes: DataFrame) -> DataFrame:
    """The pin (pin, n) of all buckets' digests (b, d, n)."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])
    mid = nodes.groupBy(F.substring("b", 1, 2).alias("b")).agg(F.sha2(F.concat_ws("", in_order), 256).alias("d"), F.sum("n").alias("n"))
    return mid.agg(F.sha2(F.concat_ws("", in_order), 256).alias("pin"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def manifest(rows: DataFrame, manifest_id: str, columns: Sequence[str] | None = None, key: str = "instrument_id", time: str = "vt") -> DataFrame:
    """One row: id, pin, count, range of times and number of instruments of a table."""
    shape = rows.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(key).alias("n_instruments")).withColumn("_k", F.lit(1))
    pin = snapshot_pin(rows, columns).withColumn("_k", F.lit(1))
    return pin.join(shape, "_k").select(F.lit(manifest_id).alias("manifest_id"), "pin", "n", "first", "last", "n_instruments")


def verify(rows: DataFrame, frozen: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``frozen`` manifests with ``matches``: whether the rows still have the pin and count."""
    now = snapshot_pin(rows, columns).select(F.col("pin").alias("_pin"), F.col("n").alias("_n"), F.lit(1).alias("_k"))
    return frozen.withColumn("_k", F.lit(1)).join(now, "_k").withColumn("matches", (F.col("pin") == F.col("_pin")) & (F.col("n") == F.col("_n"))).drop("_k", "_pin", "_n")


#: Levels of an aligned subtree, which is made by one task at a time of 2 ** SUBTREE leaves.
SUBTREE = 10


def _parents(nodes: Column, more: Column) -> Column:
    """The next level of an array of hex nodes; an odd last one pairs with itself.  Where ``more`` is false the level is the same."""
    half = F.floor((F.size(nodes) + 1) / 2).cast("int")
    pair = lambda k: F.sha2(F.concat(F.get(nodes, 2 * k), F.coalesce(F.get(nodes, 2 * k + 1), F.get(nodes, 2 * k))), 256)
    return F.when(more, F.transform(F.sequence(F.lit(0), half - 1), pair)).otherwise(nodes)


def _once(array: Column) -> Column:
    """An array as a column of its own, which a generator keeps from being written into each use."""
    return F.explode(F.array(array))


def _subtrees(nodes: DataFrame, total: int, depth: int) -> DataFrame:
    """(b, levels) of nodes (i, h): the levels of each aligned subtree of 2 ** depth nodes, up to its root.

    A tree of one subtree ends where one node is left; in a larger tree a lone
    last node goes on pairing with itself up to the subtrees' roots.
    """
    width = 1 << depth
    rows = nodes.groupBy(F.floor(F.col("i") / width).alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("l0"))
    height = min(depth, max(0, (total - 1).bit_length())) if total <= width else depth
    for k in range(height):
        rows = rows.select("b", *(f"l{j}" for j in range(k + 1)), _once(_parents(F.col(f"l{k}"), F.lit(True))).alias(f"l{k + 1}"))
    return rows.select("b", F.array(*(f"l{k}" for k in range(height + 1))).alias("levels"))


def merkle_levels(leaves: DataFrame, leaf: str = "leaf", depth: int = SUBTREE) -> list[DataFrame]:
    """The tree over sorted hex leaves as tables (b, levels) of aligned subtrees; the last one has the root alone on top.

    Leaves are numbered by one range sort and dealt to their subtree by one
    exchange; a further tier has a row for each subtree of the one below.  A parent is
    the SHA-256 of its two children's hex, and an odd last node pairs with itself.
    """
    parts = leaves.select(F.col(leaf).alias("h")).repartitionByRange("h").sortWithinPartitions("h").withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()).persist()
    sizes = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n"))  # a row for each partition
    nodes = parts.join(F.broadcast(before), "p").select((F.col("before") + F.col("m") - F.col("low")).alias("i"), "h")
    n = parts.count()
    if not n:
        parts.unpersist()
        raise ValueError("no leaves")
    tiers = []
    while True:
        tier = _subtrees(nodes, n, depth).persist()
        tiers.append(tier)
        if len(tiers) == 1:
            tier.count()
            parts.unpersist()
        if n <= 1 << depth:
            return tiers
        nodes = tier.select(F.col("b").alias("i"), F.get(F.element_at("levels", -1), F.lit(0)).alias("h"))
        n = -(-n // (1 << depth))


def merkle_root(leaves: DataFrame, leaf: str = "leaf", depth: int = SUBTREE) -> str:
    """The root of ``merkle_levels``."""
    tiers = merkle_levels(leaves, leaf, depth)
    root = tiers[-1].select(F.get(F.element_at("levels", -1), F.lit(0)).alias("h")).first()["h"]
    for tier in tiers:
        tier.unpersist()
    return root


STEPS = "array<struct<left:boolean,h:string>>"


def merkle_proofs(tiers: Sequence[DataFrame], depth: int = SUBTREE) -> DataFrame:
    """(i, leaf, proof) of every leaf of ``merkle_levels``: what a leaf is hashed with up to the root, each with its side.

    A tier's subtrees get the steps above them from the tier above, a row for each subtree.
    """
    width, proofs = 1 << depth, None
    for tier in reversed(tiers):
        top = F.size("levels") - 1

        def own(k: Column) -> Column:
            def step(level: Column) -> Column:
                nodes, at = F.get("levels", level), F.call_function("shiftright", k, level)
                beside = F.when(at % 2 == 1, F.get(nodes, at - 1)).otherwise(F.coalesce(F.get(nodes, at + 1), F.get(nodes, at)))
                return F.struct((at % 2 == 1).alias("left"), beside.alias("h"))

            return F.when(top > 0, F.transform(F.sequence(F.lit(0), top - 1), step)).otherwise(F.array().cast(STEPS))

        met = tier.withColumn("above", F.array().cast(STEPS)) if proofs is None else tier.join(proofs.select(F.col("i").alias("b"), F.col("proof").alias("above")).hint("merge"), "b")
        leaves = F.transform(F.get("levels", F.lit(0)), lambda leaf, k: F.struct(k.alias("k"), leaf.alias("leaf"), F.concat(own(k), F.col("above")).alias("proof")))
        proofs = met.select("b", F.explode(leaves).alias("x")).select((F.col("b") * width + F.col("x.k")).alias("i"), "x.leaf", "x.proof")
    return proofs


def proven_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.when(step["left"], F.concat(step["h"], h)).otherwise(F.concat(h, step["h"])), 256))


def proof_digests(tiers: Sequence[DataFrame], depth: int = SUBTREE) -> DataFrame:
    """(leaf, n_steps, proof, verified) of every leaf: a digest of its steps, and whether they give the root.

    A proof has a node for each level; what is joined further on is of one size.
    """
    root = tiers[-1].select(F.get(F.element_at("levels", -1), F.lit(0)).alias("root"))
    proofs = merkle_proofs(tiers, depth).crossJoin(F.broadcast(root))  # one row
    steps = F.transform("proof", lambda x: F.concat(F.when(x["left"], "<").otherwise(">"), x["h"]))
    return proofs.select("leaf", F.size("proof").alias("n_steps"), F.sha2(F.concat_ws("", steps), 256).alias("proof"), (proven_root(F.col("leaf"), F.col("proof")) == F.col("root")).alias("verified"))


def stable_id(*columns: str) -> Column:
    """An id from named columns, whatever their order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def group_fingerprint(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, n, fingerprint): a digest of each group's rows in any order.

    Digests are summed by prefix before they are listed, so a large group's
    list has at most 4096 entries.
    """
    d = rows.select(*by, row_digest(rows, columns).alias("d"))
    part = d.groupBy(*by, F.substring("d", 1, 3).alias("b")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("d"))), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return part.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])), 256).alias("fingerprint"))


def rerun_differences(a: DataFrame, b: DataFrame, key: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Keys of two runs whose values differ or that only one has."""
    left = a.select(*key, F.struct(*value).alias("_a"))
    right = b.select(*key, F.struct(*value).alias("_b"))
    return left.join(right, list(key), "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, F.col("_a").isNull().alias("only_b"), F.col("_b").isNull().alias("only_a"))


def unstable_keys(runs: DataFrame, key: Sequence[str], digest: str, run: str = "run") -> DataFrame:
    """(key, n_digests, n_seen, n_runs) of keys that have several digests over the runs, or aren't in every one."""
    n = runs.agg(F.count_distinct(run).alias("n_runs"))
    found = runs.groupBy(*key).agg(F.count_distinct(digest).alias("n_digests"), F.count_distinct(run).alias("n_seen"))
    return found.crossJoin(F.broadcast(n)).filter((F.col("n_digests") > 1) | (F.col("n_seen") != F.col("n_runs")))  # n has one row


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): rows that one result has more often than the other."""
    both = a.select(*sorted(a.columns)).withColumn("_w", F.lit(1)).unionByName(b.select(*sorted(b.columns)).withColumn("_w", F.lit(-1)))
    net = both.groupBy(*sorted(a.columns)).agg(F.sum("_w").alias("w"))
    return net.agg(F.coalesce(F.sum(F.greatest("w", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("w"), F.lit(0))), F.lit(0)).alias("only_b"))


def freeze(rows: DataFrame, path: str, manifest_id: str, order: Sequence[str]) -> None:
    """Rows as JSON in range-sorted files and their manifest beside them."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("ignoreNullFields", "false").json(f"{path}/rows")
    manifest(rows, manifest_id).write.parquet(f"{path}/manifest")
