"""Exact Jaccard self-join of documents by their word n-grams, in metric-space regions.

Jaccard distance d = 1 - similarity is a metric, so a pivot p separates two
sets x and y whenever |d(x, p) - d(y, p)| is over the radius r.  Document pivots
can't divide a corpus as a whole, though: nearly every pair of documents is at
distance exactly 1, so that a window of the triangle inequality holds
everything.  A filter that loses no link therefore comes first, and pivots
divide what it leaves:

1. Filter.  The empty set is a pivot of the symmetric-difference metric: sets
   fall into rings by their size, with windows.  In a ring, n-grams are dealt to
   classes by a hash.  Linked sets differ in at most k elements, so they have
   the same content in all but k classes.  A set's contents of classes are its
   cells, and it needs a number of partners' cells that follows from its size; a
   set with fewer cells that any other set has is linked with nothing, and of
   the rest only the rarest that must hold a common one are kept.  Sets that
   share a kept cell are joined into regions.
2. Pivots in Spark.  A region that is too large for a task is divided: sets go
   to the nearest of several pivots, boundary sets are copied to each pivot of
   lower number within the window of two radii, sets far from all pivots are a
   cell of their own, and cells that are still too large are divided again.
   What no pivot divides is joined in pairs of blocks.
3. Pivots in a task.  A region is joined by pivots too: one pivot's neighbours
   within the radius are its core, sets within two radii its boundary; core and
   core, and core and boundary, are compared at once, and the core goes.

Every pair is compared in one place only, at every level: a mask tells which
copies are both boundary (or both in one block) and meet elsewhere.  So links
are counted, not only connected.  Documents with equal sets are one node.

N-grams are 64-bit hashes, and so is a set's key (at 10^9 different sets two
share a key with a probability of 3 %).  Similarities are compared as integers.

Defined cases: a null text is an empty text; a document without words has no
n-grams, is linked with nothing and is a component of its own; a text with
fewer words than ``n`` has its whole sequence as one n-gram; repeated rows are
equal sets; a null id is never the smallest of a component that has another;
further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._components import components
from ._shared import Scratch, map_batches, without
from ._words import mix, shingles, split_words, text_pieces

#: N-grams that a region may hold to be joined in one task.
REGION_GRAMS = 3_000_000
#: Pivots of a division in Spark, divisions before blocks are made, and neighbours from which a pivot's core is compared at once.
PIVOTS, LEVELS, CORE = 16, 3, 48
#: Sets of a task that are remembered so that copies in it give no second row.
SEEN = 500_000
#: Bits of the filter for each shared cell, and the most that are broadcast; beyond it cells are joined without a filter.
BITS_EACH, MOST_BITS = 16, 1 << 29
SHIFTS = (0, 17, 34)
#: Bits of a mask that tell the two blocks of a pair apart.
LEFT, RIGHT = 1 << 61, 1 << 62

CELLS = "array<struct<ring:int,need:int,cells:array<bigint>>>"


@cache
def rings(num: int, den: int) -> list[tuple[int, int, int]]:
    """(least size, end size, classes) of each ring of sizes of the larger set of a pair; no classes if no two different sets link there."""
    out, low = [], 1
    while low < 1 << 31:
        end = low + max(1, low // 2)
        differ = 2 * (end - 1) * (den - num) // (den + num)
        classes = 0
        if differ:
            base = differ + 1 + differ // 4
            empty = base * np.exp(-low / base)
            classes = base + 1 + int(empty + 3 * np.sqrt(empty))
        out.append((low, end, classes))
        low = end
    return out


def signatures(gram: np.ndarray, mixed: np.ndarray, num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """(ring, cells needed, cells) of a sorted set in each ring that it belongs to."""
    n, out = len(gram), []
    for k, (low, end, classes) in enumerate(rings(num, den)):
        if n * den < num * low:
            break
        if n >= end or not classes:
            continue
        at = ((gram >> np.uint64(32)) * np.uint64(classes)) >> np.uint64(32)
        head = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        cells = mix(np.add.reduceat(mixed, head) ^ mix(at[head] * np.uint64(4096) + np.uint64(k)))
        differ = (n + min(end - 1, n * den // num)) * (den - num) // (den + num)
        need = len(head) - differ
        if need < 1:  # too many classes are empty: being empty counts as a cell too
            empty = np.setdiff1d(np.arange(classes, dtype=np.uint64), at[head])
            cells, need = np.concatenate([cells, mix(mix(empty * np.uint64(4096) + np.uint64(k)))]), 1
        out.append((k, need, np.unique(cells)))
    return out


def _sets(batch: pa.RecordBatch, column: int, n: int):
    """(row, sorted distinct n-grams, their finalised hashes, key) of each row with words."""
    for first, _, data, offsets in text_pieces(batch.column(column)):
        gram, of_text = shingles(split_words(data, offsets), n)
        for k in np.flatnonzero(np.diff(of_text)):
            own = np.unique(gram[of_text[k] : of_text[k + 1]])
            mixed = mix(own + np.uint64(0x1F83D9ABFB41BD6B))
            key = mix(np.array([mixed.sum(dtype=np.uint64) ^ np.uint64(len(own))])).view(np.int64)[0]
            yield first + k, own, mixed, key


def _cells(batches, n: int, num: int, den: int):
    """(cell, node) of every set, once in a task for sets that it remembers."""
    seen: set[int] = set()
    for batch in batches:
        cells, nodes, count = [], [], []
        for _, own, mixed, node in _sets(batch, 0, n):
            if node not in seen:
                seen.add(node)
                if found := signatures(own, mixed, num, den):
                    cells.append(np.concatenate([x for _, _, x in found]))
                    nodes.append(node)
                    count.append(len(cells[-1]))
        if len(seen) > SEEN:
            seen.clear()
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), count))], ["cell", "node"])


def _profile(batches, n: int, num: int, den: int, wanted):
    """(id, mark, n_shingles, node) of each row, and of sets that may be linked their shared cells by ring and their n-grams."""
    seen: set[int] = set()
    bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
    ring = pa.struct([("ring", pa.int32()), ("need", pa.int32()), ("cells", pa.list_(pa.int64()))])
    for batch in batches:
        size, key, cells, grams = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [None] * len(batch), [None] * len(batch)
        for row, own, mixed, node in _sets(batch, 2, n):
            size[row], key[row] = len(own), node
            if node not in seen:
                seen.add(node)
                kept = []
                for k, need, all_ in signatures(own, mixed, num, den):
                    all_ = all_.view(np.int64)
                    if bits is not None:
                        inside = np.ones(len(all_), bool)
                        for shift in SHIFTS:
                            at = (all_ >> shift) & (8 * len(bits) - 1)
                            inside &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                        all_ = all_[inside]
                    if len(all_) >= need:
                        kept.append({"ring": k, "need": need, "cells": all_})
                if kept:
                    cells[row], grams[row] = kept, own.tobytes()
        if len(seen) > SEEN:
            seen.clear()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size), pa.array(key, mask=size == 0), pa.array(cells, pa.list_(ring)), pa.array(grams, pa.binary())],
            ["id", "mark", "n_shingles", "node", "rings", "grams"],
        )


def _filter_of(cells: DataFrame) -> bytes | None:
    """A Bloom filter of the keys, sized by their number; none where it would be over MOST_BITS.

    It only spares work: a key outside the table that passes is dropped by the join.
    """
    bits = 1 << max(20, (BITS_EACH * cells.count() - 1).bit_length())
    if bits > MOST_BITS:
        return None
    places = F.array(*(F.shiftright("cell", shift).bitwiseAND(F.lit(bits - 1)) + F.lit(1) for shift in SHIFTS))
    bit = cells.select(F.explode(places).alias("bit"))
    rows = bit.select(F.bitmap_bucket_number("bit").alias("part"), F.bitmap_bit_position("bit").alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(bits // 8)
    for row in rows.toLocalIterator():
        out[(row["part"] - 1) * 4096 : row["part"] * 4096] = row["bits"]
    return bytes(out)


class Region:
    """Sets of one region; ``links`` counts the documents that each is linked with and ``root`` is a union-find over them."""

    def __init__(self, nodes: list[int], copies: list[int], masks: list[int], sets: list[np.ndarray], num: int, den: int):
        self.nodes, self.num, self.den = nodes, num, den
        self.copies, self.mask = np.array(copies, np.int64), np.array(masks, np.int64)
        self.size = np.array([len(x) for x in sets], np.int64)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(flat)
        rank = np.empty(len(often), np.int32)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.int32)
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), self.size)
        order = np.lexsort((rank[flat], owner))
        self.flat, self.at = rank[flat][order], np.concatenate([[0], np.cumsum(self.size)])  # a set's n-grams, the rarest first
        by = np.argsort(self.flat, kind="stable")
        self.holder, self.first = owner[by], np.concatenate([[0], np.cumsum(np.sort(often))])  # who has an n-gram
        self.marked = np.zeros(len(often), bool)
        self.root, self.links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def unite(self, x: int, rows: np.ndarray) -> None:
        for y in rows.tolist():
            a, b = self.find(x), self.find(y)
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of ``rows``, one after the other, and where each begins."""
        size = self.size[rows]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        return self.flat[np.arange(size.sum()) + np.repeat(self.at[rows] - begin, size)], begin

    def near(self, x: int, alive: np.ndarray, num: int) -> tuple[np.ndarray, np.ndarray]:
        """Living rows whose similarity to ``x`` may be num / den, and the n-grams that they share with it.

        Such a row has one of the rarest size - ceil(num / den * size) + 1 n-grams of ``x``.
        """
        n, den = int(self.size[x]), self.den
        own = self.flat[self.at[x] : self.at[x + 1]]
        rows = np.unique(np.concatenate([self.holder[self.first[g] : self.first[g + 1]] for g in own[: n - -(-num * n // den) + 1].tolist()]))
        rows = rows[alive[rows] & (self.size[rows] * den >= num * n) & (self.size[rows] * num <= den * n) & (rows != x)]
        if not len(rows):
            return rows, rows
        grams, begin = self.gather(rows)
        self.marked[own] = True
        common = np.add.reduceat(self.marked[grams], begin, dtype=np.int64)
        self.marked[own] = False
        return rows, common

    def run(self) -> Region:
        alive, wide = np.ones(len(self.nodes), bool), max(1, 2 * self.num - self.den)
        for x in range(len(self.nodes)):
            if not alive[x]:
                continue
            rows, common = self.near(x, alive, self.num)
            core = rows[self.den * common >= self.num * (self.size[rows] + self.size[x] - common)]
            if len(core) < CORE:
                met = core[(self.mask[core] & self.mask[x]) == 0]
                self.links[x] += self.copies[met].sum()
                self.links[met] += self.copies[x]
                self.unite(x, core)
                alive[x] = False
                continue
            rows, common = self.near(x, alive, wide)
            edge = rows[self.den * common >= wide * (self.size[rows] + self.size[x] - common)]
            self.unite(x, core)
            core = np.append(core, x)
            self.cross(core, np.setdiff1d(edge, core))
            alive[core] = False
        return self

    def cross(self, core: np.ndarray, edge: np.ndarray, block: int = 256) -> None:
        """Compare the rows of ``core`` with each other and with those of ``edge``."""
        rows, n = np.concatenate([core, edge]), len(core)
        grams, begin = self.gather(rows)
        grams, local = np.unique(grams, return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), self.size[rows])
        often = np.bincount(local, minlength=len(grams))
        dense = np.flatnonzero(often * 8 >= len(rows))
        column = np.full(len(grams), -1)
        column[dense] = np.arange(len(dense))
        flat = np.zeros((len(rows), len(dense)), np.float32)
        flat[owner[column[local] >= 0], column[local[column[local] >= 0]]] = 1
        rest = np.flatnonzero((column[local] < 0) & (often[local] > 1))  # of these few rows each have one, so they are met by lists
        held, of = local[rest], owner[rest]
        by = np.argsort(held, kind="stable")
        holder, low = of[by], np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(grams)))])
        cut = np.searchsorted(of, np.arange(len(rows) + 1))
        size, copies, mask = self.size[rows], self.copies[rows], self.mask[rows]
        touched = np.full(len(edge), -1)
        for at in range(0, n, block):
            end = min(n, at + block)
            common = (flat[at:end] @ flat.T).astype(np.int64)
            own = held[cut[at] : cut[end]]
            if len(own):
                many = low[own + 1] - low[own]
                place = np.repeat(low[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                np.add.at(common, (np.repeat(of[cut[at] : cut[end]] - at, many), holder[place]), 1)
            hit = self.den * common >= self.num * (size[at:end, None] + size[None, :] - common)
            if len(edge):
                some = hit[:, n:].any(axis=0)
                touched[some] = at + hit[:, n:][:, some].argmax(axis=0)
            hit &= (mask[at:end, None] & mask[None, :]) == 0
            hit[np.arange(end - at), np.arange(at, end)] = False
            self.links[core[at:end]] += hit @ copies
            self.links[edge] += copies[at:end] @ hit[:, n:]
        for k in np.flatnonzero(touched >= 0):
            self.unite(int(core[touched[k]]), edge[k : k + 1])


def _join_regions(batches, num: int, den: int):
    """Rows (part, node, mask, copies, grams) come sorted by part; gives (a, b, links): a node, the smallest that it reaches in the part, and its links there."""
    part, held = None, ([], [], [], [])

    def close():
        nodes, copies, masks, sets = held
        out = []
        if len(nodes) > 1:
            region = Region(nodes, copies, masks, sets, num, den).run()
            out = [(x, nodes[region.find(k)], n) for k, (x, n) in enumerate(zip(nodes, region.links.tolist(), strict=True)) if n or region.find(k) != k]
        for x in held:
            x.clear()
        return out

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "links"])

    for batch in batches:
        rows = []
        for key, node, mask, copies, grams in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if key != part:
                rows += close()
                part = key
            for x, y in zip(held, (node, copies, mask, np.frombuffer(grams, np.uint64)), strict=True):
                x.append(y)
        yield batch_of(rows)
    yield batch_of(close())


def _near_pivots(key, rows: pa.Table, pivots: pa.Table, num: int, den: int, bit: int) -> pa.Table:
    """The cells of one block's sets: that of the nearest pivot or, far from all, one of their own; and as boundary those before it within the window.

    A set is far from all pivots beyond 1 - 2 r (or r, if that is more).
    """
    order = np.argsort(pivots["node"].to_numpy())
    centres = [np.frombuffer(pivots["grams"][int(k)].as_py(), np.uint64) for k in order]
    size, radius = np.array([len(x) for x in centres]), 1 - num / den
    far, out = max(radius, 1 - 2 * radius), []
    for node, mask, grams in zip(rows["node"].to_pylist(), rows["mask"].to_pylist(), rows["grams"], strict=True):
        own = np.frombuffer(grams.as_py(), np.uint64)
        common = np.array([len(np.intersect1d(own, x, assume_unique=True)) for x in centres])
        away = 1 - common / (size + len(own) - common)
        home = int(away.argmin()) if away.min() <= far else len(centres)
        out.append((node, home, mask))
        window = min(away.min() + 2 * radius, far + radius) + 1e-9
        out += [(node, int(p), mask | bit) for p in np.flatnonzero(away[:home] <= window)]
    return pa.table({"part": pa.array([key[0].as_py()] * len(out), pa.int64())} | {name: pa.array([x[k] for x in out], pa.int64()) for k, name in enumerate(("node", "pivot", "mask"))})


def _divide(parts: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """(part, node, n, mask) of parts that each fit in a task, from parts that don't.

    Every pair of a part is in one of its cells in which not both have the mask's bit.
    """
    done = None
    for level in range(LEVELS):
        weight = scratch.write(parts.groupBy("part").agg(F.sum("n").alias("grams")), "weights")
        held = parts.join(sets.hint("merge"), "node")
        chosen = parts.groupBy("part").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)])).alias("chosen"))
        centre = scratch.write(chosen, "chosen").select("part", F.explode("chosen").alias("node")).join(sets.hint("merge"), "node").select("part", "node", "grams")
        blocks = weight.select("part", F.ceil(F.col("grams") / F.lit(REGION_GRAMS / 4)).alias("blocks"))
        dealt = held.join(blocks.hint("merge"), "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        copied = centre.join(blocks.hint("merge"), "part").select("part", "node", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).cast("bigint").alias("block"))
        both = dealt.select("part", "node", "mask", "grams", "block").groupBy("part", "block").cogroup(copied.groupBy("part", "block"))
        near = both.applyInArrow(partial(_near_pivots, num=num, den=den, bit=1 << level), "part bigint, node bigint, pivot bigint, mask bigint")
        sizes = sets.select("node", "n")
        cells = scratch.write(near.select(F.xxhash64("part", "pivot").alias("part"), "node", "mask").join(sizes.hint("merge"), "node"), "cells_of_pivots")
        heavy = scratch.write(cells.groupBy("part").agg(F.sum("n").alias("grams")), "heavy")
        cells = cells.join(heavy.hint("merge"), "part").select("part", "node", "n", "mask", "grams")
        fits = cells.filter(F.col("grams") <= REGION_GRAMS).drop("grams")
        done = fits if done is None else done.unionByName(fits)
        parts = scratch.write(cells.filter(F.col("grams") > REGION_GRAMS), "over")
        if not parts.limit(1).count():
            return done
        if level < LEVELS - 1:
            parts = parts.drop("grams")
    large = parts.withColumn("blocks", F.ceil(F.col("grams") / F.lit(REGION_GRAMS / 2))).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), "blocks"))
    pairs = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") < F.col("other"), F.lit(LEFT)).when(F.col("own") > F.col("other"), F.lit(RIGHT)).otherwise(F.lit(0))
    return done.unionByName(pairs.select(F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "node", "n", F.col("mask").bitwiseOR(side).alias("mask")))


def link(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, mark, n_shingles, n_links, component_id, first): documents link when den * |x & y| >= num * |x | y|.

    ``mark`` is a hash of the row's text, ``n_links`` the number of other rows
    that the row is linked with and ``first`` whether it has the smallest id of
    its component (of rows with that id, the text with the smallest mark).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("mark"), "text")
    kind = dict(texts.dtypes)["id"]
    pairs = map_batches(texts.select("text"), partial(_cells, n=n, num=num, den=den), "cell bigint, node bigint")
    shared = pairs.groupBy("cell").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count(F.lit(1)).alias("often")).filter("leader < last").select("cell", "often")
    shared = scratch.write(shared, "shared")
    bits = _filter_of(shared)
    wanted = None if bits is None else spark.sparkContext.broadcast(bits)
    schema = f"id {kind}, mark bigint, n_shingles bigint, node bigint, rings {CELLS}, grams binary"
    profile = scratch.write(map_batches(texts, partial(_profile, n=n, num=num, den=den, wanted=wanted), schema), "profile")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("mark")))
    nodes = scratch.write(profile.filter("node is not null").groupBy("node").agg(best.alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")

    sets = profile.filter("grams is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("rings").alias("rings"), F.first("grams").alias("grams"))
    sets = scratch.write(sets.join(nodes.select("node", "copies").hint("merge"), "node"), "sets")
    rows = sets.select("node", F.inline("rings")).select("node", "ring", "need", F.explode("cells").alias("cell"))
    rows = rows.join(shared.hint("merge"), "cell")
    of_set = Window.partitionBy("node", "ring")
    rows = rows.withColumns({"has": F.count(F.lit(1)).over(of_set), "rank": F.row_number().over(of_set.orderBy("often", "cell"))})
    kept = scratch.write(rows.filter("has >= need and rank <= has - need + 1").select("cell", "node"), "kept")
    leaders = scratch.write(kept.groupBy("cell").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").drop("last"), "leaders")
    edges = kept.join(leaders.hint("merge"), "cell").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    region = components(edges, scratch, "regions")
    scratch.drop("shared", "kept", "leaders")

    region = scratch.write(region.join(sets.select("node", "n").hint("merge"), "node"), "sized")
    weight = scratch.write(region.groupBy("root").agg(F.sum("n").alias("grams")), "weight")
    region = region.join(weight.hint("merge"), "root").select(F.col("root").alias("part"), "node", "n", F.lit(0).cast("bigint").alias("mask"), "grams")
    parts = region.filter(F.col("grams") <= REGION_GRAMS).drop("grams")
    over = scratch.write(region.filter(F.col("grams") > REGION_GRAMS).drop("grams"), "large")
    if over.limit(1).count():
        parts = parts.unionByName(_divide(over, sets, scratch, num, den))
    held = parts.join(sets.select("node", "copies", "grams").hint("merge"), "node").select("part", "node", "mask", "copies", "grams")
    links = map_batches(held.repartition("part").sortWithinPartitions("part", "node"), partial(_join_regions, num=num, den=den), "a bigint, b bigint, links bigint")
    links = scratch.write(links, "links")
    roots = components(links.select("a", "b"), scratch, "roots")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    own = nodes.join(roots.hint("merge"), "node", "left").join(counts.hint("merge"), "node", "left")
    own = own.select("node", "least", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = scratch.write(own, "named")
    least = scratch.write(own.groupBy("root").agg(F.min("least").alias("first")), "least")
    named = scratch.write(own.join(least.hint("merge"), "root").select("node", "n_links", "first"), "components")
    scratch.drop(but=("profile", "components"))
    out = profile.select("id", "mark", "n_shingles", "node").filter("node is not null").join(named.hint("merge"), "node")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    out = out.select("id", "mark", "n_shingles", "n_links", F.col("first.id").alias("component_id"), is_first.alias("first"))
    alone = profile.filter("node is null").select("id", "mark", "n_shingles", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(alone)


def link_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, n_shingles, component_id, n_links)."""
    return link(docs, n, num, den, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less those that are not the first of their component; documents without words stay.

    Rows are told apart by id and text: rows that agree in both stay or go together.
    """
    return without(docs, link(docs, n, num, den, id_col, text_col).filter(~F.col("first")), id_col, text_col)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
#: Links over all pairs are quadratic in SQL; tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {}
