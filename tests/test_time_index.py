"""Running values in ranges, dominance over two times, dyadic intervals: against loops, with bounds that force every path."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitemporal, scan, time_index


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("per_range", [10**9, 40])
def test_running_values(spark, per_range):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)]), k, rng.choice([None, 0.5, 1.0, 2.0, 4.0])) for k in range(400)]
    df = spark.createDataFrame(rows, "s string, t int, k int, v double")
    found = scan.running(df, ["s"], ["t", "k"], {"total": ("sum", F.col("v")), "times": ("product", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v"))}, totals=["total"], per_range=per_range)
    got = {r["k"]: (r["total"], r["times"], r["top"], r["low"], r["total_total"]) for r in found.collect()}
    assert len(got) == 400
    for s in ("a", "b", None):
        seen, own = [], sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        whole = sum(r[3] or 0 for r in own)
        for r in own:
            seen += [r[3]] if r[3] is not None else []
            times = 1.0
            for v in seen:
                times *= v
            want = (sum(seen), times, max(seen), min(seen), whole) if seen else (None, None, None, None, whole)
            assert got[r[2]] == pytest.approx(want)


def test_ranges_need_an_order(spark):
    ends = [float(k) for k in range(0, 1000, 7)]
    df = spark.range(-5, 1010).select(F.col("id").cast("double").alias("x"))
    assert all(r["n"] == sum(e < r["x"] for e in ends) for r in df.withColumn("n", scan.range_number(F.col("x"), ends)).collect())
    with pytest.raises(ValueError):
        scan.range_ends(spark.createDataFrame([("a",)] * 3, "x string"), "x", 1)


@pytest.mark.parametrize("per_range", [10**9, 50])
def test_dominance_against_loops(spark, per_range):
    rng = random.Random(5)
    when = lambda: rng.choice([None, *map(day, range(25))])
    facts = [(rng.choice("aaab"), when(), when(), rng.choice([2.0, 0.5, 4.0, None])) for _ in range(150)]
    points = [(rng.choice("aabc"), when(), when(), k % 60) for k in range(180)]
    points += points[:7]  # repeated rows stay
    f = spark.createDataFrame(facts, "i string, vt date, kt date, ratio double")
    p = spark.createDataFrame(points, "i string, vt date, kt date, point int")
    found = time_index.dominated(p, f, "i", ("vt", "kt"), {"ratio": ("product", F.col("ratio")), "n": ("sum", F.lit(1))}, per_range=per_range)
    got = sorted(map(repr, (tuple(r) for r in found.select("i", "vt", "kt", "point", "ratio", "n").collect())))
    want = []
    for i, vt, kt, k in points:
        met = [r for j, v, w, r in facts if j == i and None not in (v, w, vt, kt) and v <= vt and w <= kt]
        product = None
        for r in met:
            product = r if product is None else product * (1.0 if r is None else r) if r is not None else product
        want.append(repr((i, vt, kt, k, product, len(met) or None)))
    assert got == sorted(want)


def test_splits_meet_points_without_a_join_in_time(spark):
    f = spark.createDataFrame([("a", day(1), day(1), 2.0)], "instrument_id string, vt date, kt date, ratio double")
    p = spark.createDataFrame([("a", day(2), day(2))], "instrument_id string, vt date, kt date")
    found = bitemporal.split_ratio(p, f)
    assert [tuple(r) for r in found.collect()] == [("a", day(2), day(2), 2.0)]
    assert "Join" not in plan(found)


def test_rows_in_blocks_grow_with_the_logarithm(spark):
    """A fact and a point of one key are in a block for about every other bit of the key's size."""
    for n in (300, 3000):
        rows = spark.range(n).select(F.lit("a").alias("i"), F.date_add(F.lit(day(0)), (F.col("id") * 7919 % n).cast("int")).alias("vt"), F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("kt"))
        dealt, _ = time_index.in_blocks(rows, rows, "i", ("vt", "kt"), [F.lit(1)])
        assert dealt.count() <= 2 * n * n.bit_length()
        assert dealt.groupBy("_level", "_block").count().agg(F.max("count")).first()[0] < 2 * n


@pytest.mark.parametrize("begin,end", [(0, 0), (5, 4), (-7, 100), (3, 66), (1, 719), (19000, 2932896)])
def test_covers_are_exact(spark, begin, end):
    df = spark.createDataFrame([(begin, end)], "a int, b int").select(F.explode_outer(time_index.cover(F.col("a"), F.col("b"))).alias("n"))
    nodes = [(r["n"]["level"], r["n"]["node"]) for r in df.collect() if r["n"]]
    held = sorted((n << 2 * k, (n + 1) << 2 * k) for k, n in nodes)
    assert len(nodes) <= 6 * time_index.NODE_LEVELS
    if begin > end:
        assert not nodes
    else:
        assert held[0][0] == begin and held[-1][1] == end + 1 and all(a[1] == b[0] for a, b in zip(held, held[1:], strict=False))


def test_intervals_against_loops(spark):
    rng = random.Random(9)
    edges = [(k, rng.choice("xy"), day(a := rng.randrange(400)), rng.choice([None, day(a + rng.randrange(-3, 300)), dt.date(9999, 12, 31)]), day(rng.randrange(400))) for k in range(120)]
    points = [(k, rng.choice("xyz"), rng.choice([None, day(rng.randrange(700))]), day(rng.randrange(700))) for k in range(200)]
    e = spark.createDataFrame(edges, "src int, dst string, valid_from date, valid_to date, known_at date")
    p = spark.createDataFrame(points, "point int, dst string, vt date, kt date")
    meets = lambda vt, kt, e: None not in (vt, e[3]) and e[2] <= vt <= e[3] and e[4] <= kt
    both = bitemporal.edges_at_points(e, p, ["dst"])
    assert sorted((r["point"], r["src"]) for r in both.collect()) == sorted((q[0], x[0]) for q in points for x in edges if q[1] == x[1] and meets(q[2], q[3], x))
    one = bitemporal.edges_at_points(e, p.drop("kt"), ["dst"])
    assert sorted((r["point"], r["src"]) for r in one.collect()) == sorted((q[0], x[0]) for q in points for x in edges if q[1] == x[1] and q[2] and meets(q[2], q[2], x))
    join = [line for line in plan(one).split("\n") if "SortMergeJoin" in line]
    assert join and all("_node" in line and "<=" not in line for line in join)


def test_a_large_cell_is_many_tasks(spark):
    """All points and intervals of one key and day: each pair is there once, and no task has them all."""
    e = spark.createDataFrame([(k, "x", day(3), day(5)) for k in range(40)], "src int, dst string, valid_from date, valid_to date")
    p = spark.createDataFrame([(k, "x", day(4)) for k in range(300)], "point int, dst string, vt date")
    found = time_index.stabbed(p, e, ["dst"], "vt", "valid_from", "valid_to", pairs=500).withColumn("task", F.spark_partition_id())
    assert found.select("point", "src").distinct().count() == found.count() == 40 * 300
    sizes = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 12000 / 4


def long_and_many(spark, intervals, points):
    e = spark.range(intervals).select(F.col("id").alias("src"), F.lit("x").alias("dst"), F.lit(day(0)).alias("valid_from"), F.lit(day(700)).alias("valid_to"))
    p = spark.range(points).select(F.col("id").alias("point"), F.lit("x").alias("dst"), F.date_add(F.lit(day(3)), (F.col("id") % 600).cast("int")).alias("vt"))
    return p, e


def test_levels_move_the_fewest_rows():
    """Nodes of each level that lie whole in intervals of 676 days: many points are in one node, as many as intervals in one of each level, and no mask for short ones."""
    whole = [676 // 4**k for k in range(time_index.NODE_LEVELS)]
    assert time_index.levels_for(150_000, 1000, 676_000, [1000 * n for n in whole])[0] == (3, 3)
    first, last = time_index.levels_for(1000, 1000, 676_000, [1000 * n for n in whole])[0]
    assert first < last
    assert time_index.levels_for(150_000, 1000, 2000, [2000, *[0] * 11]) == [(0, 0)]
    assert all(first == 0 for first, _ in time_index.levels_for(150_000, 1000, 676_000, [1000 * n for n in whole])[1:])


def test_a_point_is_moved_once(spark):
    """Many points and long intervals: the join's side of points is dealt by one node of a point, not by one of each level."""
    p, e = long_and_many(spark, 20, 6000)
    found = time_index.stabbed(p, e, ["dst"], "vt", "valid_from", "valid_to")
    assert found.count() == 20 * 6000
    assert not any("explode(array(" in line for line in plan(found).split("\n"))


def test_a_result_takes_few_bytes(spark, tmp_path):
    """A row of the result has an interval and a point; files hold each of them far less often than that."""
    p, e = long_and_many(spark, 1501, 4801)
    time_index.stabbed(p, e, ["dst"], "vt", "valid_from", "valid_to").write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == rows.select("point", "src").distinct().count() == 1501 * 4801
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.25 * 1501 * 4801


@pytest.mark.parametrize("pairs,held", [(None, None), (300, 7), (10**9, 5)])
def test_parts_of_points_and_intervals(spark, pairs, held):
    """Short, long, open and empty intervals over the days of masks and nodes: each pair once, whatever the parts."""
    rng = random.Random(11)
    when = lambda: day(rng.randrange(-90, 500))
    e = [(k, rng.choice(["x", "x", "y", None]), a := when(), rng.choice([None, a, a + dt.timedelta(rng.randrange(-2, 400)), dt.date(9999, 12, 31)])) for k in range(90)]
    q = [(k % 350, rng.choice(["x", "x", "z", None]), rng.choice([None, when(), day(63), day(64)])) for k in range(400)]
    found = time_index.stabbed(spark.createDataFrame(q, "point int, dst string, vt date"), spark.createDataFrame(e, "src int, dst string, valid_from date, valid_to date"), ["dst"], "vt", "valid_from", "valid_to", pairs, held)
    want = sorted((p, d, v, s) for p, d, v in q for s, f, a, b in e if d and d == f and v and b and a <= v <= b)
    assert sorted((r["point"], r["dst"], r["vt"], r["src"]) for r in found.collect()) == want and len(want) > 500
    assert time_index.stabbed(spark.createDataFrame([], "point int, dst string, vt date"), spark.createDataFrame(e, "src int, dst string, valid_from date, valid_to date"), ["dst"], "vt", "valid_from", "valid_to").count() == 0


@pytest.mark.parametrize("begin,end", [(0, 0), (63, 64), (64, 127), (-70, 5), (3, 60), (1, 719), (70, 127), (128, 200), (5, 4)])
@pytest.mark.parametrize("level", [1, 3])
def test_masks_are_exact(spark, begin, end, level):
    size = 4**level
    df = spark.createDataFrame([(begin, end)], "a int, b int").select(time_index.ends_of(F.col("a"), F.col("b"), level).alias("m"), time_index.cover(F.col("a"), F.col("b"), level, 5).alias("c"))
    r = df.first()
    held = [x["node"] * size + k for x in r["m"] or [] for k in range(size) if x["mask"] >> k & 1]
    assert all(x["mask"] >> size & 1 == 0 or size == 64 for x in r["m"] or [])
    held += [k for x in r["c"] or [] for k in range(x["node"] << 2 * x["level"], (x["node"] + 1) << 2 * x["level"])]
    assert sorted(held) == list(range(begin, end + 1))


def test_masks_that_decide_too_often_are_not_used(spark):
    """All points are on the day after the intervals: no pair is made to be turned down."""
    e = spark.range(50).select(F.col("id").alias("src"), F.lit("x").alias("dst"), F.lit(day(0)).alias("valid_from"), F.lit(day(200)).alias("valid_to"))
    p = spark.range(3000).select(F.col("id").alias("point"), F.lit("x").alias("dst"), F.when(F.col("id") == 0, F.lit(day(0))).otherwise(F.lit(day(201))).alias("vt"))
    found = time_index.stabbed(p, e, ["dst"], "vt", "valid_from", "valid_to")
    assert found.count() == 50 and "1.0E" not in plan(found)
