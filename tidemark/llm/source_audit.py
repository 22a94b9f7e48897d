"""How the sources of a language diverge: counts of terms by 64-bit digests, with strings joined back for what is kept.

A term is a run of letters A-Z, a-z and characters outside ASCII, A-Z in lower
case.  Pieces of an Arrow batch are added up first; then counting shuffles a
term's digest, of fixed width, and never its text.  A second pass over the texts
finds the smallest and the largest string of each digest; where they differ, terms have collided, and those digests alone are
counted again by their strings and split into numbered parts.  The strings of
a digest meet a result again only where it is returned.

In a language the terms of at least ``MIN_DOCS`` documents are kept, V of them.
With N counts of kept terms in a group (of a language and source, or the
language itself) a term of c counts has p = 1 + floor(10^9 (c + 1) / (N + V)), and
its divergence from q is floor((p - q)^2 / q), all in whole numbers.

The sum over all kept terms for each pair of sources works on blocks of terms
(``BLOCK_ROWS`` rows of a source and term about), cogrouped with the sources of
the language; a block is worked on as small dense arrays and returns a row for
each pair of sources, so no row is made for a pair of a term.  The
``TOP`` terms of a group are found in two steps: the least value among the first
ones, a number for each group, and then all that reach it, which are ranked
with their strings under a limit that Spark applies before it shuffles.

Defined cases: a null text, language or source is an empty one; a group without
terms is there with no counts; a language without kept terms has pairs of value
0 and no terms; repeated rows are documents of their own; ties are ordered by the
item's bytes; texts of any length count whole; ids and further columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._shared import FEW_ROWS, Scratch, map_batches
from ._words import LOWER, hash_ranges, text_pieces

#: Bytes of terms: letters, and every byte of a character outside ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text that are worked on at once, and sums that a task holds before it gives them out.
PIECE_BYTES, HELD = 4 << 20, 1_000_000
UNIT, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Rows of a block of terms, and cells of a dense array within it.
BLOCK_ROWS, CELLS = 400_000, 1 << 20
KEY = ["digest", "part"]


def distinct_terms(data: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, the number of each occurrence's term, its text) of texts that follow one another in ``data``."""
    data = data.translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    inside = INSIDE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    edge = np.append(np.cumsum(inside)[start] - 1, inside.sum()).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(raw[inside])]).dictionary_encode()
    return terms.dictionary, terms.indices.to_numpy(), np.searchsorted(offsets, start, side="right") - 1


def digests_of(terms: pa.Array, bits: int) -> np.ndarray:
    """64-bit digests of strings, or the lowest ``bits`` of them."""
    _, edge, data = terms.buffers()
    edge = np.frombuffer(edge, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    found = hash_ranges(bytes(data) if data else b"", edge[:-1], edge[1:])
    return (found & np.uint64((1 << bits) - 1)).view(np.int64)


class Sums:
    """Counts of digests in groups, added up over pieces until there are ``HELD`` rows of them."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, group: np.ndarray, digest: np.ndarray, n: np.ndarray, docs: np.ndarray) -> bool:
        self.rows.append((group, digest, n, docs))
        self.held += len(group)
        return self.held >= HELD

    def take(self) -> pa.RecordBatch:
        group, digest, n, docs = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((group, digest))
        group, digest = group[order], digest[order]
        head = np.ones(len(group), bool)
        head[1:] = (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])
        head = np.flatnonzero(head)
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        of = pa.array(group[head])
        columns = [langs.take(of), sources.take(of), pa.array(digest[head]), pa.array(np.add.reduceat(n[order], head)), pa.array(np.add.reduceat(docs[order], head))]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "digest", "n", "docs"])


def _term_rows(batches, what: str, bits: int):
    """What the rows (lang, source, text) of a task have, added up: digests, or their strings, or both."""
    sums = Sums()
    for batch in batches:
        lang, source, column = batch.columns
        for row, end, data, offsets in text_pieces(column, PIECE_BYTES):
            if not data:
                continue
            terms, number, text = distinct_terms(data, offsets)
            if not len(terms):
                continue
            digest = digests_of(terms, bits)
            if what == "names":
                yield pa.RecordBatch.from_arrays([pa.array(digest), terms], ["digest", "term"])
                continue
            pairs = zip(lang.slice(row, end - row).to_pylist(), source.slice(row, end - row).to_pylist(), strict=True)
            group = np.array([sums.groups.setdefault(pair, len(sums.groups)) for pair in pairs], np.int64)
            own, n = np.unique(number * np.int64(end - row) + text, return_counts=True)  # a term of a document
            number, text = own // (end - row), own % (end - row)
            wide = len(sums.groups)
            own, at = np.unique(number * np.int64(wide) + group[text], return_inverse=True)  # a term of a group
            total, docs = (np.bincount(at, w).astype(np.int64) for w in (n, None))
            number, group = own // wide, own % wide
            if what == "both":  # few of these are wanted, so they aren't held
                of = [*sums.groups]
                columns = [pa.array([of[g][k] for g in group.tolist()], pa.string()) for k in (0, 1)]
                columns += [pa.array(digest[number]), pa.array(total), pa.array(docs), terms.take(pa.array(number))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "digest", "n", "docs", "term"])
            elif sums.add(group, digest[number], total, docs):
                yield sums.take()
    if sums.held:
        yield sums.take()


def term_rows(texts: DataFrame, what: str, bits: int = 64) -> DataFrame:
    """Rows of ``texts`` (lang, source, text) added up by pieces: ``counts`` without strings, ``names`` (digest, term) or ``both``."""
    schema = {"names": "digest bigint, term string", "counts": "lang string, source string, digest bigint, n bigint, docs bigint"}
    return map_batches(texts, partial(_term_rows, what=what, bits=bits), schema.get(what) or schema["counts"] + ", term string")


def counted(texts: DataFrame, scratch: Scratch, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(counts, names): counts (lang, source, digest, part, n, docs) and names (digest, part, term), one for each term."""
    sums = (F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.write(term_rows(texts, "counts", bits).groupBy("lang", "source", "digest").agg(*sums).withColumn("part", F.lit(0)), "counts")
    names = scratch.write(term_rows(texts, "names", bits).groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "names")
    collided = scratch.write(names.filter("low <> high").select("digest"), "collided")
    n = collided.count()
    if not n:
        return counts, names.select("digest", F.lit(0).alias("part"), F.col("low").alias("term"))
    hint = "broadcast" if n <= FEW_ROWS else "merge"
    again = term_rows(texts, "both", bits).join(collided.hint(hint), "digest", "left_semi").groupBy("lang", "source", "digest", "term").agg(*sums)
    again = scratch.write(again, "again")
    parts = scratch.write(again.select("digest", "term").distinct().withColumn("part", F.row_number().over(Window.partitionBy("digest").orderBy("term"))), "parts")
    split = again.join(parts.hint("merge"), ["digest", "term"]).select(*counts.columns)
    counts = scratch.write(counts.join(collided.hint(hint), "digest", "left_anti").unionByName(split), "split")
    single = names.filter("low = high").select("digest", F.lit(0).alias("part"), F.col("low").alias("term"))
    return counts, scratch.write(single.unionByName(parts.select("digest", "part", "term")), "terms")


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a term with ``n`` counts: 1 + floor(10^9 (n + 1) / (total + kept)), exact for any counts."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + 1), wide(total + kept))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs_of_block(rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """The sums over a block's terms of the divergence of each pair of sources."""
    groups = groups.sort_values("source")
    own, base = groups["source"].to_numpy(), groups["base"].to_numpy(np.int64)
    n = len(own)
    if n < 2 or not len(rows):
        return _sums([], np.array([], object), np.array([], object), np.array([], np.int64))
    column = np.searchsorted(own, rows["source"].to_numpy())
    order = np.lexsort((rows["part"].to_numpy(), rows["digest"].to_numpy()))
    digest, part, column, p = rows["digest"].to_numpy()[order], rows["part"].to_numpy()[order], column[order], rows["p"].to_numpy(np.int64)[order]
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (part[1:] != part[:-1])
    term = np.cumsum(new) - 1
    total = np.zeros((n, n), np.int64)
    step = max(1, CELLS // n)
    for at in range(0, int(term[-1]) + 1, step):
        lo, hi = np.searchsorted(term, [at, at + step])
        dense = np.repeat(base[:, None], min(step, int(term[-1]) + 1 - at), axis=1)
        dense[column[lo:hi], term[lo:hi] - at] = p[lo:hi]
        for b in range(n):
            gap = dense - dense[b]
            total[:, b] += (gap * gap // dense[b]).sum(axis=1)
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    return _sums([groups["lang"].iloc[0]] * len(a), own[a], own[b], total[a, b])


def _sums(lang, source, item, value) -> pd.DataFrame:
    return pd.DataFrame({"lang": np.array(lang, object), "source": np.asarray(source, object), "item": np.asarray(item, object), "value": value}, copy=False).astype({"lang": object, "source": object, "item": object})


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language, over all its kept terms.

    ``shares`` (lang, source, digest, part, p) has the terms that a source has;
    ``groups`` (lang, source, base, rows) has p of the others and the number of
    a language's rows, by which its blocks are counted.
    """
    ship(shares.sparkSession)
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    of_lang = groups.groupBy("lang").agg(F.max(blocks).alias("blocks"))
    dealt = shares.join(of_lang.hint("broadcast"), "lang").withColumn("block", F.pmod(F.xxhash64(*KEY), F.col("blocks")).cast("int"))
    everywhere = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1))).select("lang", "source", "base", "block")
    both = dealt.select("lang", "block", "source", *KEY, "p").groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block"))
    found = both.applyInPandas(_pairs_of_block, "lang string, source string, item string, value bigint")
    return found.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with each other one, ``term`` names what marks it.

    Fewer ``bits`` make digests collide, for tests.
    """
    scratch = Scratch(docs.sparkSession)
    plain = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    texts = docs.select(plain(lang, "lang"), plain(source, "source"), plain(text, "text"))
    counts, names = counted(texts, scratch, bits)
    kept = scratch.write(counts.groupBy("lang", *KEY).agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).filter(F.col("docs") >= min_docs).select("lang", *KEY, "in_lang"), "kept")
    held = scratch.write(counts.join(kept.hint("merge"), ["lang", *KEY]).select("lang", "source", *KEY, "n", "in_lang"), "held")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("lang_total"))
    of_group = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    every = texts.select("lang", "source").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    groups = every.join(of_group.hint("merge"), ["lang", "source"], "left").join(of_lang.hint("merge"), "lang", "left")
    groups = scratch.write(groups.select("lang", "source", zero("total"), zero("kept"), zero("lang_total"), zero("own")), "groups")
    hint = "broadcast" if groups.count() <= FEW_ROWS else "merge"

    shares = held.join(groups.select("lang", "source", "total", "kept", "lang_total").hint(hint), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    shares = scratch.write(shares.select("lang", "source", *KEY, p.alias("p"), q.alias("q")), "shares")

    base = F.when(F.col("kept") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(1)
    sized = groups.withColumn("rows", F.sum("own").over(Window.partitionBy("lang"))).select("lang", "source", base.alias("base"), "rows")
    sums = scratch.write(pair_sums(shares, scratch.write(sized, "sized")), "sums")
    a, b = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    pairs = a.join(b.hint("merge"), "lang").filter("source <> item").join(sums.hint("merge"), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))

    found = scratch.write(shares.filter("p > q").select("lang", "source", *KEY, divergence(F.col("p"), F.col("q")).alias("value")), "found")
    by = Window.partitionBy("lang", "source")
    first = found.withColumn("_k", F.row_number().over(by.orderBy(F.desc("value")))).filter(F.col("_k") <= top)
    least = scratch.write(first.groupBy("lang", "source").agg(F.min("value").alias("least")), "least")
    reach = found.join(least.hint(hint), ["lang", "source"]).filter("value >= least").select("lang", "source", *KEY, "value")
    named = scratch.write(reach.join(names.hint("merge"), KEY).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"), "named")
    order = by.orderBy(F.desc("value"), "item")
    terms = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = scratch.write(pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms), "audit")
    scratch.drop(but=("audit",))
    return out


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_source_audit": op13_source_audit}
ORACLE_SQL = {
    "op13_source_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (coalesce(n.n, 0) + l.v) AS p, 1 + 1000000000::HUGEINT * (k.c + 1) // (l.n + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM s WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200
"""
}
