"""Merkle manifests, sentence pieces and source audits against plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _shared, merkle_manifest, registry, sentence_pieces, source_audit
from tidemark.llm._tokens import vocabulary_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank bigint, node string, grp string, digest bigint, term string, ids string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, la, s, n, 7, "x", "y", 7, "z", "w") for i, t, la, s, n in rows], SCHEMA)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + arity])) for k in range(0, len(out[-1]), arity)])
    return out


def path(tree, i, arity):
    for nodes in tree[:-1]:
        first = i // arity * arity
        run = nodes[first : first + arity]
        yield run[: i - first], run[i - first + 1 :]
        i //= arity


def plain_manifest(rows, arity):
    """Sorted (id, leaf, subroot, root, proof, folded) of rows, by lists."""
    groups = defaultdict(list)
    for i, t, la, s, n in rows:
        leaf = h("".join(map(part, (i, s, la, n, t))))
        changed = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups[la].append(((i is not None, i or 0, leaf), i, leaf, h("".join(map(part, (i, s, la, n + 1, t)))) if changed else leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[0])
        trees[name] = levels([x[2] for x in groups[name]], arity)
    top = levels([trees[name][-1][0] for name in names], arity)
    out = []
    for k, name in enumerate(names):
        for i, (_, doc, leaf, now) in enumerate(groups[name]):
            steps = [*path(trees[name], i, arity), *path(top, k, arity)]
            for a, b in steps:
                now = h("".join(a) + now + "".join(b))
            out.append((doc, leaf, trees[name][-1][0], top[-1][0], h("".join(x for a, b in steps for x in a + b)), now, now == top[-1][0]))
    return sorted(out, key=repr)


ROWS = [(None, None, None, None, None), (1, "", "", "", 0), (2, "x" * 9000, "de", "s", 9000), (3, "é漢", "é", None, None), (3, "é漢", "é", None, None), (None, "b", "de", "s", 1), (7, "z", "only", "s", 1)]


@pytest.mark.parametrize("arity,digits", [(2, 6), (2, 2), (3, 1)])
def test_manifest_against_lists(spark, monkeypatch, arity, digits):
    rng = random.Random(arity)
    rows = ROWS + [(rng.randrange(200), f"t{rng.randrange(50)}", rng.choice(["de", "en", "en", None]), "s", k) for k in range(150)]
    plain = merkle_manifest.manifest
    monkeypatch.setattr(merkle_manifest, "manifest", lambda *a, **b: plain(*a, arity=arity, digits=digits, **b))
    monkeypatch.setattr(merkle_manifest, "SparkSession", None, raising=False)
    docs = table(spark, rows)
    reader = type("Reader", (), {"parquet": lambda self, _: docs})()
    found = merkle_manifest.op11_merkle_manifest(type("Session", (), {"read": reader, "sql": spark.sql, "conf": spark.conf, "sparkContext": spark.sparkContext, "table": spark.table})(), "")
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == plain_manifest(rows, arity)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_leaf_and_none(spark):
    one = merkle_manifest.manifest(table(spark, [(5, "a", "en", "s", 1)])).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["path"]) for r in one] == [(one[0]["leaf"],) * 3 + ([],)]
    assert merkle_manifest.manifest(table(spark, [])).count() == 0


def test_equal_rows_are_parted(spark):
    """A third of all rows are one row: they have ranks of their own and lie in several ranges."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"), F.lit("en").alias("grp"), F.lit("h").alias("h"), F.monotonically_increasing_id().alias("tie"))
    scratch = _shared.Scratch(spark)
    found = merkle_manifest.ranked(scratch.write(rows, "rows"), "grp", ["id", "h", "tie"], scratch, "placed")
    ranks = sorted(r[0] for r in found.select("rank").collect())
    assert ranks == list(range(3000))
    [placed] = [t for t, name in scratch.tables.items() if name == "placed"]
    assert spark.table(placed).filter("id = 0").select("_range").distinct().count() > 1
    scratch.drop()


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Encoder(vocabulary_path("piece_bpe_32k.model"))


def encoded(pieces, texts):
    ids, back = [], []
    for flat, at in pieces.batches(pa.array(texts, pa.string())):
        ids += [flat[at[k] : at[k + 1]].tolist() for k in range(len(at) - 1)]
        back += sentence_pieces.decode(pieces.v, flat, at).to_pylist()
    return ids, back


def test_pieces_against_the_library_over_whole_texts(pieces):
    rng = random.Random(1)
    odd = [None, "", " ", "  ", "a  b", "\n a\t\tb\n", "é漢字😀", "▁a", "a\x00b", "<s>x</s>", "<0x41>", "\xa0x", "ﬁ", "a\r\nb", "​x", "x" * 5000, "aba" * 3000, " " * 777, "漢字" * 4000, " ▁▁ x▁y", "⁇ <unk>"]
    odd += ["".join(rng.choices("abcde  \n\té▁漢😀AB.,thein0", k=rng.randrange(150))) for _ in range(1500)]
    ids, back = encoded(pieces, odd)
    texts = [t or "" for t in odd]
    assert ids == pieces.v.library.encode(texts, add_bos=True, add_eos=True)
    assert back == pieces.v.library.decode(ids)


def test_both_agendas_agree(pieces, monkeypatch):
    words = [w for w in re.findall(r" ?\w+", "The tokenization of antidisestablishmentarianism and internationalisierung " * 2)] + ["aaaaaaaaaaaa", "abababababab"]
    ids, _ = encoded(pieces, words)
    for long in (0, 3):
        monkeypatch.setattr(sentence_pieces, "LONG", long)
        pieces.forget()
        assert encoded(pieces, words)[0] == ids
    monkeypatch.setattr(sentence_pieces, "MOST_UNITS", 3)
    assert encoded(pieces, words)[0] == ids


def test_any_ids_decode_as_in_the_library(pieces):
    rng = random.Random(2)
    lists = [[rng.randrange(400) for _ in range(rng.randrange(9))] for _ in range(1500)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.array([y for x in lists for y in x], np.int32)
    assert sentence_pieces.decode(pieces.v, flat, at).to_pylist() == [pieces.v.library.decode(x) for x in lists]


def test_a_wrong_merge_is_an_error(pieces):
    ids, count = pieces.encode([b" hello", b"x"])
    with pytest.raises(ValueError):
        pieces.check([b" hello", b"x"], ids[::-1].copy(), count)


def test_pieces_of_the_given_table(spark, data):
    library = sentence_pieces.vocabulary(vocabulary_path("piece_bpe_32k.model")).library
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = registry.queries()["op12_sentence_pieces"](spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == h(library.decode(ids))


def test_pieces_of_odd_rows(spark):
    rows = table(spark, [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3)])
    found = sentence_pieces.encode(rows).select("doc_id", F.hex("ids").alias("ids"), "decoded").collect()
    assert [(r["doc_id"], r["decoded"]) for r in found] == [(None, ""), (1, ""), (1, "a b"), (1, "a b")]
    assert found[0]["ids"] == found[1]["ids"] == "0100000002000000"
    assert sentence_pieces.encode(table(spark, [])).count() == 0


def plain_audit(rows, min_docs=3, top=200):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    terms = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or ""))) for _, t, la, s, _ in rows]
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    gap = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang in {x[0] for x in terms}:
        docs = Counter(w for la, _, ws in terms if la == lang for w in set(ws))
        kept = {w for w, n in docs.items() if n >= min_docs}
        counts = {s: Counter(w for la, x, ws in terms if (la, x) == (lang, s) for w in ws if w in kept) for la, s, _ in terms if la == lang}
        whole = sum(counts.values(), Counter())
        p = {s: {w: share(c[w], sum(c.values()), len(kept)) for w in kept} for s, c in counts.items()}
        q = {w: share(whole[w], sum(whole.values()), len(kept)) for w in kept}
        for s in counts:
            pair = [("pair", b, sum(gap(p[s][w], p[b][w]) for w in kept)) for b in counts if b != s]
            term = [("term", w, gap(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for items, most in ((pair, None), (term, top)):
                items.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, name, item, value, k + 1) for k, (name, item, value) in enumerate(items[:most])]
    return sorted(out)


def audit_rows():
    rng = random.Random(4)
    words = ["Alpha", "ALPHA", "beta9gamma", "É", "é", "漢字", "x-y", "delta", "eps", "zeta", "eta", "theta"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), 1) for k in range(120)]
    return rows + [(1, None, "xx", "a", 1), (2, "", "xx", "b", 1), (3, "once", "yy", "a", 1), (3, "once", "yy", "a", 1), (4, "w " * 40_000, "en", "s1", 1), (5, "123 --", "zz", "a", 1)]


@pytest.mark.parametrize("bits,top", [(64, 200), (3, 200), (1, 2)])
def test_audit_against_dictionaries(spark, bits, top, monkeypatch):
    """Also with digests of a few bits, where nearly all terms collide and are split, and with few terms a group."""
    monkeypatch.setattr(source_audit, "BLOCK_ROWS", 10)
    monkeypatch.setattr(source_audit, "HELD", 20)
    rows = audit_rows()
    found = source_audit.audit(table(spark, rows), bits=bits, top=top)
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(rows, top=top)


def test_audit_of_nothing(spark):
    assert source_audit.audit(table(spark, [])).count() == 0
    assert source_audit.audit(table(spark, [(1, None, None, None, None)])).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_source_audit"])
def test_matches_sql(spark, data, duck, name):
    found = registry.queries()[name](spark, data)
    theirs = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, theirs.fetchall()))
