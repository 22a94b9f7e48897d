"""Exact dedup, n-gram Jaccard join, decontamination and the pipeline against brute force."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import decontaminate, exact_dedup, ngram_join, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def grams(t, n):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    met, links = {}, [0] * len(rows)
    for k, s in enumerate(sets):
        for g in s:
            met.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in met[g] if j < k).items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
                links[k] += 1
                links[j] += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i, links[k]) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, base, copies, words=120):
    r = random.Random(seed)
    out, i = [], 0
    for b in range(base):
        text = [f"v{r.randrange(400)}" for _ in range(r.randrange(8, words))]
        for _ in range(r.randrange(1, copies)):
            own = list(text)
            for _ in range(r.randrange(0, 1 + len(own) // 12)):
                own[r.randrange(len(own))] = f"u{r.randrange(10**6)}"
            out.append((i, " ".join(own)))
            i += 1
    return out


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_decontaminate"])
def test_matches_sql(spark, data, duck, name):
    found = registry.queries()[name](spark, data)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())


def test_op2_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, registry.queries()["op2_ngram_jaccard"](spark, data).collect()), key=str) == plain_components(rows, 3, 90, 100)


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_near_copies(make, n, num):
    rows = near_copies(n, 25, 12)
    assert sorted(map(tuple, ngram_join.link_components(make(rows), n, num, 100).collect()), key=str) == plain_components(rows, n, num, 100)


@pytest.mark.parametrize("bound", [400, 3000])
def test_regions_over_their_bound(make, monkeypatch, bound):
    """Regions, cells and Voronoi cells that are too large for a task give the same links."""
    monkeypatch.setattr(ngram_join, "REGION_GRAMS", bound)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    rows = near_copies(9, 3, 40, 60)
    assert sorted(map(tuple, ngram_join.link_components(make(rows), 3, 80, 100).collect()), key=str) == plain_components(rows, 3, 80, 100)


@pytest.mark.parametrize("core", [1, 8, 48])
def test_region_recursion_in_a_task(monkeypatch, core):
    import numpy as np

    monkeypatch.setattr(ngram_join, "CORE", core)
    rows = near_copies(4, 6, 60, 150)
    sets = [frozenset(grams(t, 3)) for _, t in rows]
    number = {g: k for k, g in enumerate({g for s in sets for g in s})}
    region = ngram_join.Region(list(range(len(rows))), [1] * len(rows), [0] * len(rows), [np.array(sorted(number[g] for g in s), np.uint64) for s in sets], 85, 100).run()
    roots = np.array([region.find(k) for k in range(len(rows))])
    plain = {i: c for i, _, c, _ in plain_components(rows, 3, 85, 100)}
    assert region.links.tolist() == [n for *_, n in sorted(plain_components(rows, 3, 85, 100))]
    assert {frozenset(np.flatnonzero(roots == r).tolist()) for r in set(roots.tolist())} == {frozenset(i for i in plain if plain[i] == c) for c in set(plain.values())}


def test_odd_rows(make, odd_rows):
    docs = make(odd_rows)
    found = {tuple(r) for r in ngram_join.link_components(docs, 3, 90, 100).collect()}
    assert {(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0)} <= found
    assert sorted(found, key=str) == sorted(set(plain_components(odd_rows, 3, 90, 100)), key=str)
    dedup = {r["doc_id"]: r for r in exact_dedup.dedup(docs).collect()}
    assert dedup[1]["keep_id"] == 3 and dedup[1]["group_size"] == 3 and dedup[6]["group_size"] == 2 and dedup[5]["kept"]
    kept = [r["doc_id"] for r in exact_dedup.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([3, None, 5, 6, 7, 8, 9, 10], key=str)
    assert sorted((r["doc_id"] for r in ngram_join.keep_one(docs).collect()), key=str) == sorted([1, 2, 3, None, 5, 7, 9, 10], key=str)


def test_empty_tables(make, spark):
    none = make([]).limit(0)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert exact_dedup.dedup(none).count() == exact_dedup.keep_one(none).count() == 0
    assert ngram_join.link_components(none).count() == 0
    assert decontaminate.find(none, items).count() == 0
    assert decontaminate.find(make([(1, "a b c d e f")]), items).count() == 0


def test_index_over_batches(spark, make):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.dedup(make([(5, "a b"), (6, "c")]), index).count()
    assert exact_dedup.DigestIndex(spark, index.name).rows().count() == 2
    later = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(make([(1, "ab"), (2, "d"), (3, "d ")]), index).collect()}
    assert later == {1: (5, False), 2: (3, False), 3: (3, True)}
    assert index.rows().count() == 3
    more = index.rebucket(7)
    assert {bytes(r["digest"]) for r in more.rows().collect()} == {bytes(r["digest"]) for r in index.rows().collect()}
    exact_dedup.dedup(make([(9, "d"), (10, "e")]), more).count()
    assert more.rows().count() == 4


def test_one_off_index_goes(spark, make):
    before = {t.name for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name) if "digest_index" in t.name}
    assert exact_dedup.dedup(make([(1, "a"), (2, "a ")])).count() == 2
    assert {t.name for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name) if "digest_index" in t.name} == before


def test_rows_are_told_apart_by_text(make):
    """Clean rows that share an id, or have none, with a rejected one stay."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (None, a + " z"), (None, b), (2, a + " y"), (2, c)]
    kept = {(r["doc_id"], r["text"]) for r in ngram_join.keep_one(make(rows), 5, 80, 100).collect()}
    assert kept == {(1, a), (None, b), (2, c)}


def test_pipeline_of_odd_rows(spark, data, odd_rows, tmp_path):
    """Nulls, empties, repeats, a very long text and clashing columns through all stages, and an empty table."""
    import shutil

    import corpus_pipeline

    for name, rows in (("odd", odd_rows), ("none", [])):
        folder = tmp_path / name
        folder.mkdir()
        for t in ("labels", "benchmark"):
            shutil.copy(f"{data}/{t}.parquet", folder / f"{t}.parquet")
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, node bigint, cells string"
        spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, "c") for i, t in rows], schema).write.parquet(str(folder / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(folder)).collect()
        if not rows:
            assert found == []
        else:
            assert {r["doc_id"] for r in found} == {3, None, 5, 7, 9, 10}  # one of the empty texts, of the equal ones and of the two long ones


def test_passages(make, spark, monkeypatch):
    r = random.Random(2)
    word = lambda: f"q{r.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(r.randrange(3, 60)))) for k in range(20)] + [(20, None), (21, "")]
    docs = []
    for i in range(80):
        body = [word() for _ in range(r.randrange(0, 400))]
        if i % 3 == 0:
            own = WORD.findall(items[r.randrange(20)][1])
            for _ in range(r.randrange(0, 2 + len(own) // 20)):
                own[r.randrange(len(own))] = "z"
            at = r.randrange(len(body) + 1)
            body[at:at] = [w.upper() if r.random() < 0.3 else w for w in own]
        docs.append((i, " ".join(body)))
    plain = set()
    for d, t in docs:
        for k, own in items:
            g = grams(own, 5)
            if g and 100 * len(g & grams(t, 5)) >= 80 * len(g):
                plain.add((d, k, len(g), len(g & grams(t, 5))))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    pick = lambda: {(x["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for x in decontaminate.find(make(docs), table).collect()}
    assert plain and pick() == plain
    monkeypatch.setattr(decontaminate, "INLINE", 0)
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    assert pick() == plain


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "packing":
            assert out.columns == names
        rows = out.collect()
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "exact_dedup":
            bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
            assert len({bare(t) for t in before.values()}) == len(rows) == len({bare(r["text"]) for r in rows})
        if name == "ngram_jaccard":
            assert sorted(r["doc_id"] for r in rows) == sorted({c for _, _, c, _ in plain_components(list(before.items()), 5, 80, 100)})
        if name == "decontaminate":
            items = [grams(r["text"], 5) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert {r["doc_id"] for r in rows} == {d for d, t in before.items() if not any(g and 100 * len(g & grams(t, 5)) >= 80 * len(g) for g in items)}
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
        else:
            texts = {r["doc_id"]: r["text"] for r in rows}
            assert all(before[i] == t for i, t in texts.items())
            docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.run(spark, data).count() > 0


def test_copies_are_reduced_before_they_are_dealt(spark, make):
    """A text that is a third of all rows is one row before the anti-join with an index that has digests already."""
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.dedup(make([(k, f"t{k}") for k in range(20)]), index).count()
    rows = make([(100 + k, "hot" if k % 3 == 0 else f"u{k}") for k in range(300)])
    marks = exact_dedup.Scratch(spark).write(exact_dedup.digests(rows), "marks")
    found = exact_dedup.Scratch(spark).write(exact_dedup.groups(marks), "groups")
    new = index.unknown(found)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Aggregate" not in plan and plan.count("Exchange") == 1
    assert found.count() == new.count() == 201
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(rows, index).collect()}
    assert got[100] == (100, 100, True) and got[103] == (100, 100, False) and got[101] == (101, 1, True)
    again = exact_dedup.dedup(rows, index)
    assert again.filter("kept").count() == 0 and again.filter("keep_id = 100").count() == 100
    index.drop()
