"""Mutual rank correlations, against each pair's own ranking."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import search

SCHEMA = "fold_id int, candidate string, instrument_id string, value double"


def plain(rows):
    out, by = {}, {}
    for fold, c, i, v in rows:
        if v is not None:
            by.setdefault((fold, c), {})[i] = v
    for (f, a), (g, b) in combinations(sorted(by), 2):
        both = sorted(by[f, a].keys() & by[g, b].keys()) if f == g else []
        if both:
            ranks = [np.argsort(np.argsort([by[f, c][i] for i in both], kind="stable"), kind="stable") for c in (a, b)]
            flat = len(both) < 2 or len({by[f, a][i] for i in both}) == 1
            out[f, a, b] = (len(both), 0.0 if flat else round(float(np.corrcoef(*ranks)[0, 1]), 9))
    return out


def test_every_pair(spark):
    """Sets of instruments that are equal, nested, crossing and apart; ties, constants, nulls, a lone instrument, many chunks."""
    rng, rows = random.Random(5), []
    for fold in (1, 2):
        for k in range(12):
            has = {0: range(40), 1: range(40), 2: range(10, 40), 3: range(20), 4: range(45, 60), 5: [59]}[k % 6]
            rows += [(fold, f"c{k:02}", f"i{i:02}", None if k == 7 and i % 5 == 0 else 2.0 if k == 8 else float(rng.randrange(6 if k < 6 else 1000))) for i in has]
    values = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for chunk in (7, 1000):
        found = {(r["fold_id"], r["candidate"], r["other"]): (r["n"], round(r["rank_ic"], 9) + 0.0) for r in search.mutual_ic(values, chunk=chunk).collect()}
        assert found.keys() == want.keys()
        assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-8 for k in want)


def test_no_rows(spark):
    assert search.mutual_ic(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_of_a_full_grid(spark):
    """210 candidates send a row for each two of them and each chunk, not for each instrument."""
    names = list(search.factor_grid())
    grid = spark.range(300).select(F.lit(0).alias("fold_id"), F.explode(F.array(*map(F.lit, names))).alias("candidate"), F.concat(F.lit("i"), "id").alias("instrument_id"))
    values = grid.withColumn("value", F.pmod(F.xxhash64("candidate", "instrument_id"), F.lit(1000)).cast("double"))
    found = search.mutual_ic(values)
    assert found.count() == len(names) * (len(names) - 1) // 2 and found.filter("n <> 300 OR abs(rank_ic) > 0.5").count() == 0
    assert "Generate explode" in found._jdf.queryExecution().executedPlan().toString()  # of an instrument's sets, which is one here
