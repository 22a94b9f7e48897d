"""Snapshots and folds over restated facts, against plain reads of the whole history."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitemporal as B
from tidemark.operators.snapshots import FactStore


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


SCHEMA = "namespace string, instrument_id string, vt date, kt date, revision int, value double"


def history(seed, n=400, span=90):
    rng, out = random.Random(seed), {}
    for _ in range(n):
        vt, revision = rng.randrange(span), rng.randrange(4)
        key = (rng.choice(["bar", "macro"]), rng.choice("abc"), day(vt), revision)
        out.setdefault(key, (*key[:3], day(vt + rng.randrange(20)), revision, rng.choice([None, float(rng.randrange(9))])))
    return list(out.values())


def test_any_day_from_snapshots(spark, tmp_path):
    rows = history(1)
    facts = spark.createDataFrame(rows, SCHEMA)
    store = FactStore(spark, f"store_{uuid.uuid4().hex}", buckets=3, path=str(tmp_path))
    columns = ["namespace", "instrument_id", "vt", "kt", "revision", "value"]
    same = lambda a, b: sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))
    cut = [day(25), day(60)]
    store.append(facts.filter(F.col("kt") <= cut[0]))
    store.compact(str(cut[0]))
    store.append(facts.filter((F.col("kt") > cut[0]) & (F.col("kt") <= cut[1])))
    store.compact(str(cut[1]))
    store.append(facts.filter(F.col("kt") > cut[1]))
    assert store.snapshots() == [str(d) for d in cut]
    for n in [-1, 10, *random.Random(2).sample(range(25, 110), 5)]:
        assert same(store.as_of(str(day(n))), B.as_of(facts, day(n))), n
    some = store.as_of(str(day(70)), "bar", ["a", "b"], day(20), day(50))
    assert same(some, B.as_of(facts, day(70), "bar", ["a", "b"], day(20), day(50)))

    found = store.as_of(str(day(70)))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    read = [f for f in found.inputFiles() if "_facts" in f]
    assert read and all("_known_in=2024-03" in f for f in read)  # day 60 is in March: nothing older is read but the snapshot

    late = spark.createDataFrame([("bar", "a", day(5), day(30), 9, 1.5)], SCHEMA)
    assert store.append(late) == [str(cut[1])]
    assert store.snapshots() == [str(cut[0])]
    assert same(store.as_of(str(day(70))), B.as_of(facts.unionByName(late), day(70)))
    store.drop()
    assert not spark.catalog.tableExists(store.facts_table)


def test_an_empty_store(spark, tmp_path):
    store = FactStore(spark, f"store_{uuid.uuid4().hex}", buckets=2, path=str(tmp_path))
    assert store.append(spark.createDataFrame([], SCHEMA)) == []
    store.compact("2024-01-01")
    assert store.as_of("2024-02-01").count() == 0
    store.drop()


@pytest.fixture(scope="module")
def folds(spark):
    return spark.createDataFrame([(10, day(15)), (11, day(3)), (12, day(15)), (13, day(60)), (14, None), (15, dt.date(1901, 1, 1))], "fold_id int, cutoff date")


def test_folds_see_what_a_plain_join_sees(spark, folds):
    rows = [*history(3), ("bar", None, day(1), day(2), 0, 1.0), ("bar", "a", None, day(2), 0, 1.0), ("bar", "z", dt.date(1700, 1, 1), dt.date(1701, 1, 1), 0, 2.0)]
    facts = spark.createDataFrame(rows, SCHEMA)
    met = facts.join(F.broadcast(folds), (F.col("vt") <= F.col("cutoff")) & (F.col("kt") <= F.col("cutoff")))
    plain = B.latest(met, ["fold_id", *B.KEY], F.col("revision").desc())
    found = B.as_of_folds(facts, folds)
    assert sorted(map(repr, found.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    totals = B.fold_totals(facts, folds, ["namespace"], {"v": F.col("value").cast("decimal(20,2)")})
    want = plain.groupBy("fold_id", "namespace").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("value").cast("decimal(20,2)"), F.lit(0))).alias("v"))
    assert sorted((r["fold_id"], r["namespace"], r["n"], float(r["v"])) for r in totals.collect()) == sorted((r["fold_id"], r["namespace"], r["n"], float(r["v"])) for r in want.collect())
    with pytest.raises(Exception, match="1900"):
        B.as_of_folds(facts, folds.withColumn("cutoff", F.lit(dt.date(1850, 1, 1)))).collect()
    with pytest.raises(ValueError):
        B.fold_totals(facts, folds, ["namespace"], {"v": F.col("value")})


def test_a_thousand_folds_move_each_row_once(spark):
    facts = spark.createDataFrame(history(4), SCHEMA)
    many = spark.range(1000).select(F.col("id").alias("fold_id"), F.date_add(F.lit(day(0)), (F.col("id") % 120).cast("int")).alias("cutoff"))
    found = B.as_of_folds(facts, many)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    window = plan.index("Window [min(")
    assert "explode(sequence(first_fold" in plan[:window] and "explode(sequence(first_fold" not in plan[window:]
    runs = B.visible_folds(facts, many)
    assert runs.count() <= facts.count()
    assert runs.agg(F.sum(F.col("past_fold") - F.col("first_fold"))).first()[0] == found.count() > 100 * facts.count()
