"""Scores, packing, counts, extraction and personal data against plain versions and held-out labels."""

import glob
import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import _tokens, lm_score, main_text, packing, pii, quality, registry, token_counts, toxicity
from tidemark.llm._tokens import Encoder, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def ids_of(texts):
    return Encoder(vocabulary_path()).encode([t or "" for t in texts])


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def test_lm_base(spark, data, docs):
    tokens = {i: [*WORD.findall(lower(t)), "</end>"] for i, t in docs.items()}
    train = Counter(w for i, ws in tokens.items() if crc(i, 7) != 2 for w in ws)
    z = math.log10(sum(train.values()) + len(train) + 1)
    found = registry.queries()["op3_lm_score"](spark, data).collect()
    assert len(found) == len(docs)
    for r in found:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"], 7) == 2, len(own), sum(train[w] > 0 for w in own), sum(train.values()))
        assert r["base_score"] == pytest.approx(sum(math.log10(train[w] + 1) - z for w in own))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_distinct_keys_by_sorts():
    """Distinct keys and places as numpy's own, also where keys differ in the bits that rows take, without its hash table's time."""
    r = np.random.default_rng(3)
    high = r.integers(0, 1 << 60, 3000, dtype=np.uint64) << np.uint64(4)
    cases = [high[:0], high[:1], high[r.integers(0, 3000, 9000)], r.integers(0, 50, 5000, dtype=np.uint64), np.array([5, 3, 5, 3, 1 << 63], np.uint64)]
    for keys in cases:
        own, place = lm_score._ranked(keys)
        plain, at = np.unique(keys, return_inverse=True)
        assert np.array_equal(own, plain) and np.array_equal(place, at) and np.array_equal(lm_score._distinct(keys), plain)
    keys = r.integers(0, 1 << 63, 1_200_000, dtype=np.uint64)
    begin = time.process_time()
    lm_score._distinct(keys)
    own = time.process_time() - begin
    np.unique(keys)
    assert own < (time.process_time() - begin - own) / 2


def test_automaton_against_dictionaries(make):
    """The traversal's sum is that of a recursive backoff over plain tables of the same counts."""
    rows = [(k, t) for k, t in enumerate(["a b c a b d", "a b c", "b c a b", "d d a b c", "", "c a"])]
    own = {r["doc_id"]: r["score"] for r in lm_score.score(make(rows)).collect()}
    texts = {i: [*t.split(), "</end>"] for i, t in rows}
    c = [None, Counter(), Counter(), Counter()]
    for ws in texts.values():
        led = ["</end>", *ws]
        c[1].update(ws)
        for n in (2, 3):
            c[n].update(tuple(led[k : k + n]) for k in range(len(led) - n + 1))
    total, types = sum(c[1].values()), len(c[1])
    p1 = lambda w: (c[1][w] + 1) / (total + types + 1)

    # runs of words that were met once are dropped from the table of counts
    two = {k: v for k, v in c[2].items() if v > 1}
    three = {k: v for k, v in c[3].items() if v > 1 and k[:2] in two}
    p2 = {k: (v - 0.5) / c[1][k[0]] for k, v in two.items()}
    left2 = {a: (1 - sum(p for k, p in p2.items() if k[0] == a)) / (1 - sum(p1(k[1]) for k in p2 if k[0] == a)) for a in {k[0] for k in p2}}
    below = lambda a, w: p2.get((a, w), left2.get(a, 1.0) * p1(w))
    size = {h: max(two[h], sum(v for k, v in three.items() if k[:2] == h)) for h in {k[:2] for k in three}}
    p3 = {k: (v - 0.5) / size[k[:2]] for k, v in three.items()}
    left3 = {h: (1 - sum(p for k, p in p3.items() if k[:2] == h)) / (1 - sum(below(h[1], k[2]) for k in p3 if k[:2] == h)) for h in size}
    for i, ws in texts.items():
        state, score = ("</end>",), 0.0
        for w in ws:
            if len(state) == 2 and (*state, w) in p3:
                score += math.log10(p3[(*state, w)])
            else:
                score += (math.log10(left3[state]) if len(state) == 2 else 0) + math.log10(below(state[-1], w) if state else p1(w))
            state = (state[-1], w) if state and (state[-1], w) in size else (w,)
        assert own[i] == pytest.approx(score), i


def plain_lm_scores(texts, held=()):
    """Scores of ``texts`` by a recursive backoff over dictionaries of exact counts; runs that were met once are not in the model."""
    c = [None, Counter(), Counter(), Counter()]
    for i, ws in texts.items():
        if i not in held:
            led = ["</end>", *ws]
            c[1].update(ws)
            for n in (2, 3):
                c[n].update(tuple(led[k : k + n]) for k in range(len(led) - n + 1))
    z = sum(c[1].values()) + len(c[1]) + 1
    p1 = lambda w: (c[1][w] + 1) / z
    p2 = {k: (v - 0.5) / c[1][k[0]] for k, v in c[2].items() if v > 1}
    p3 = {k: (v - 0.5) / c[2][k[:2]] for k, v in c[3].items() if v > 1}
    sums = defaultdict(lambda: [1.0, 1.0])
    for k, p in p2.items():
        sums[k[:1]][0] -= p
        sums[k[:1]][1] -= p1(k[1])
    for k, p in p3.items():
        sums[k[:2]][0] -= p
        sums[k[:2]][1] -= p2[k[1:]]
    left = {k: math.log10(max(a, 1e-6) / max(b, 1e-6)) for k, (a, b) in sums.items()}
    out = {}
    for i, ws in texts.items():
        led, total = ["</end>", *ws], 0.0
        for k in range(1, len(led)):
            a, b, w = led[k - 2] if k > 1 else None, led[k - 1], led[k]
            if (a, b, w) in p3:
                total += math.log10(p3[a, b, w])
            else:
                total += left.get((a, b), 0.0) + (math.log10(p2[b, w]) if (b, w) in p2 else left.get((b,), 0.0) + math.log10(p1(w)))
        out[i] = total
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_lm_counts_every_run(make, monkeypatch, parts):
    """A run that is met twice among 700,000 tokens is in the model, however rows fall into tasks and chunks."""
    import random

    monkeypatch.setattr(lm_score, "CHUNK", 50_000)
    r = random.Random(3)
    rows = [(k, " ".join(f"w{int(r.paretovariate(0.4)) % 30_000}" for _ in range(700))) for k in range(1000)]
    rows += [(1000, "only here twice"), (1001, "only here twice"), (1002, "only here twice")]
    docs = make(rows).repartition(parts)
    found = {x["doc_id"]: x["score"] for x in lm_score.score(docs, docs["doc_id"] % 5 == 4).collect()}
    plain = plain_lm_scores({i: [*t.split(), "</end>"] for i, t in rows}, {i for i, _ in rows if i % 5 == 4})
    assert found == pytest.approx(plain)


def held_out(spark, data, name, label, modulus, held):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = registry.queries()[name](spark, data).collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (crc(r["doc_id"], modulus) == held) for r in found)
    return [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]


def area(rows):
    pos, neg = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    return np.mean([(s > t) + (s == t) / 2 for s in pos for t in neg])


def test_quality_held_out(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    assert area(held_out(spark, data, "op4_quality", "quality", 3, 1)) > 0.97


def test_toxicity_held_out(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    rows = held_out(spark, data, "op7_toxicity", "toxic", 4, 2)
    assert area(rows) > 0.8
    assert np.mean([y for _, p, y in rows if p]) > 0.9


def test_worst_sentence(make, spark):
    clean = [f"w{a} w{b} and so on" for a in range(12) for b in range(6)]
    rows = [(k, f"{t}. More words here. The end") for k, t in enumerate(clean)]
    rows += [(100 + k, f"{t}! You awful thing. é the end") for k, t in enumerate(clean[:30])]
    labels = spark.createDataFrame([(i, 0, int(i >= 100)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    for r in toxicity.score(make(rows), labels).collect():
        text = dict(rows)[r["doc_id"]]
        assert (r["score"] >= 0.3) == (r["doc_id"] >= 100)
        if r["doc_id"] >= 100:
            assert "awful" in text[r["worst_start"] : r["worst_end"]] and text[r["worst_start"] : r["worst_end"]] == "You awful thing."
    assert toxicity.reject(make(rows), labels).count() == len(clean)


def check_packing(rows, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0 and all(r["tier"] == at for r in pieces)


def test_packing(spark, data, docs):
    ids = {i: [*x, 0] for i, x in zip(docs, ids_of(docs.values()))}
    rows = registry.queries()["op8_packing"](spark, data).collect()
    check_packing(rows, ids)
    step = Counter()
    for r in rows:
        step[r["step_id"]] += r["length"]
    assert max(step.values()) <= packing.STEP_TOKENS


def test_token_counts(spark, data, docs):
    found = registry.queries()["op10_token_counts"](spark, data).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: len(x) for i, x in zip(docs, ids_of(docs.values()))}


def test_file_numbers_beside_uuids(spark, monkeypatch, tmp_path):
    """Two files of one task, whose UUID holds what looks like a file's number."""
    monkeypatch.setattr(token_counts, "FILE_PIECES", 2)
    monkeypatch.setattr(_tokens, "PIECE_BYTES", 8)
    spark.createDataFrame([(k, "word " * k) for k in range(1, 6)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    write = token_counts.write_token_files

    def renamed(docs, path, *more):
        write(docs, path, *more)
        for file in glob.glob(f"{path}/part-*"):
            os.rename(file, re.sub(r"-.{36}-c", "-0a1b2c3d-c123-4c56-8d00-0123456789ab-c", file))

    monkeypatch.setattr(token_counts, "write_token_files", renamed)
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
    assert found == {k: len(x) for k, x in zip(range(1, 6), ids_of(["word " * k for k in range(1, 6)]))}


def test_many_files_of_many_tasks(spark, monkeypatch, tmp_path, make):
    """Three pieces a file, several files a task and several tasks; nulls, empty texts and one that is longer than a piece."""
    monkeypatch.setattr(token_counts, "FILE_PIECES", 3)
    monkeypatch.setattr(_tokens, "PIECE_BYTES", 40)
    rows = [(k, None if k % 7 == 0 else "" if k % 5 == 0 else "a word " * (k % 9) if k != 33 else "long text " * 500) for k in range(120)]
    make(rows).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
    assert found == {i: len(x) for (i, _), x in zip(rows, ids_of([t for _, t in rows]))}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_over_block_edges(spark, tmp_path, block):
    lists = [[5, 6, 7], [], [9] * 10, [1], [], [2, 3]]
    flat = [x for ids in lists for x in [*(i + 1 for i in ids), 0]] + [4, 4]
    (tmp_path / "part-00000-x-c000.txt").write_bytes(np.array(flat, "<u2").tobytes())
    (tmp_path / "part-00001-x-c000.txt").write_bytes(b"")
    found = sorted((r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in token_counts.scan(spark, str(tmp_path), block).collect())
    at, plain = 0, []
    for k, ids in enumerate(lists):
        plain.append((k, at, len(ids), True))
        at += len(ids) + 1
    assert found == [*plain, (len(lists), at, 2, False)]


def test_units_give_the_tokenizers_ids():
    import random

    import pyarrow as pa

    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "b", "é", "1", "23", "'s", "'ll", ".", "!!", "\x1c", "漢", "😀", "<|endoftext|>", "\x0b", "　", "\u0085", " ", "​"]
    texts = [None, "", *("".join(r.choices(parts[: r.choice((13, 23))], k=r.randrange(12))) for _ in range(4000))]
    coder = Encoder(vocabulary_path())
    plain = coder.encode([t or "" for t in texts])
    for first, ids, ends in coder.batches(pa.array(texts), None):
        for k in range(len(ends) - 1):
            assert ids[ends[k] : ends[k + 1]].tolist() == plain[first + k], repr(texts[first + k])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use</div><div class="ad">Buy</div>%s<section id="comments"><p>Nice one</p></section><aside>More</aside><form><p>Mail<input></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<article><header><h1>A &amp; B</h1></header><p>One <b>two</b>\n three<p>Four<br>five<div class='ad'>no</div></article>", "A & B\nOne two three\nFour\nfive"),
        ("<main><p>Caf&eacute; &#8212; &lt;p&gt;</main>", "Café — <p>"),
        ("<div><p>" + "long text here, " * 20 + "</p><p>short</p><p>" + "and more of it " * 20 + "</p></div>", ("long text here, " * 20).strip() + "\nshort\n" + ("and more of it " * 20).strip()),
    ],
)
def test_main_text(inner, text):
    assert main_text.extract(PAGE % inner)[0] == text


def test_main_text_of_pages(spark, data):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in registry.queries()["op6_main_text"](spark, data).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:h1|p|br)>", body)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


LONG = "a sentence of the story that goes on for a while, " * 8


@pytest.mark.parametrize(
    "page, has, lacks",
    [
        # the text is in a plain element beside a marked teaser
        (f"<body><article><a href='/x'>Read next: other</a></article><div><p>{LONG}<p>{LONG}<p>{LONG}</div></body>", ["a sentence of the story"], ["Read next"]),
        # links and bare tags within an article, without a name that says so
        (f"<body><article><h1>Title</h1><p>{LONG}<p>{LONG}<p>{LONG}<div class='x1'><a href='/a'>First topic</a> <a href='/b'>Second topic</a></div></article></body>", ["Title", "a sentence of the story"], ["topic"]),
        (f"<body><article><p>{LONG}<p>{LONG}" + "<div><i></i><b></b><i></i><b></b><span>|</span></div>" * 6 + "</article></body>", ["a sentence of the story"], ["|\n|"]),
        # no marks at all, and boilerplate without a listed name
        ("<body>" + "<div><span><a href='/'>Go</a></span> <span>x</span></div>" * 6 + f"<div><p>{LONG}<p>{LONG}<p>{LONG}</div></body>", ["a sentence of the story"], ["Go x\nGo x\nGo x\nGo x"]),
        # a head that isn't closed
        (f"<html><head><title>T</title><body><div><p>{LONG}</div></body></html>", ["a sentence of the story"], []),
    ],
)
def test_density_decides(page, has, lacks):
    text = main_text.extract(page)[0]
    assert all(x in text for x in has) and not any(x in text for x in lacks), text


def test_pages_without_marks(spark, data):
    """The given pages with their article's tags taken for plain ones: most of the text is found by its density."""
    rows = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()
    full = [main_text.extract(r["html"])[0] for r in rows]
    found = [main_text.extract(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r["html"]))[0] for r in rows]
    same = sum(len(x) for a, b in zip(full, found) for x in (Counter(a.split("\n")) & Counter(b.split("\n"))).elements())
    assert same > 0.85 * sum(map(len, full)) and same > 0.9 * sum(map(len, found)) - sum(b.count("\n") for b in found)


# The contract's forms as they are written there; the operator's own are others, which take no time on long runs.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_what_chunks_send():
    """Counts, keys and places come back as they were, over their whole range and for few and many buckets."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    for x in ([0, 1, 254, 255, 256, 2**40], [0], []):
        x = np.array(x, np.int64)
        assert lm_score._wide(pa.py_buffer(lm_score._small(x)), [len(x)]).tolist() == x.tolist()
    keys = np.sort(r.integers(0, 2**64, 20_000, dtype=np.uint64))
    for buckets in (1, 7, 255, 256, 1000, 70_000):
        seen = 0
        for bucket, (own,) in lm_score._deal([keys], buckets):
            mine = keys[own]
            raw = pa.py_buffer(lm_score._short(mine, buckets))
            assert len(np.unique(lm_score._long(raw, len(mine)))) == len(mine) and len(raw) == len(mine) * (8 if buckets < 256 else 7 if buckets < 65536 else 6)
            place = lm_score._in_bucket(mine, buckets)
            assert (np.diff(place.astype(np.int64)) >= 0).all() and place.max() < 1 << lm_score.PLACE_BITS
            assert lm_score._places(pa.py_buffer(lm_score._steps(place))).tolist() == place.tolist()
            seen += len(mine)
        assert seen == len(keys)


def test_fixed_spans_of_odd_texts():
    import random

    r = random.Random(5)
    parts = ["a", "b.c", "@", "@x", ".", "..", "1", "22", "255", "256", "0000", "4111 1111 1111 1111", "-", "+", "+1", "(", ")", " ", "\n", "_", "%", "é", "@@", "x@y.z", "1.2.3.4"]
    for _ in range(6000):
        text = "".join(r.choices(parts, k=r.randrange(16)))
        assert pii.spans_text(pii.fixed_spans(text)) == plain_spans(text), repr(text)


@pytest.mark.parametrize("text", ["1.2.3." + "9" * 10**6, "9" * 10**6, "a" * 10**6 + " @ x", "x@" * 300_000, "(" * 10**6, "+1" * 10**5 + "(" * 10**5, "1." * 300_000, "1 " * 500_000, ("b" * 999 + "\n") * 1000 + "@", "a@b.c " + "z" * 10**6 + " d@e.f"])
def test_long_runs_take_no_time(text):
    import time

    began = time.perf_counter()
    fixed = pii.fixed_spans(text)
    for s, e in pii.loose_spans(text, fixed)[:1000]:
        pii.in_context(text, s, e)
    assert time.perf_counter() - began < 10


def test_contexts_have_whole_words():
    word = "w" * 200
    assert pii.in_context(f"{word} call me at X now {word} then", 212, 213) == ["< me at", "> now #" + hashlib.sha256(word.encode()).hexdigest()[:16], "at _ now"]


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "</span>" * 30_000, "<span>" * 30_000 + "</div>" * 30_000, "<p>" * 30_000 + "x", "<ul>" + "<li>a" * 30_000, "<table>" + "<tr><td>a" * 20_000])
def test_deep_markup_takes_no_time(page):
    import time

    began = time.perf_counter()
    main_text.extract(page)
    assert time.perf_counter() - began < 10


def test_names_of_an_articles_own_parts():
    page = f"<body><article><h1>Soup</h1><div class='menu'><p>{LONG}</div><div class='notice'><p>{LONG}</div><div class='newsletter'><p>{LONG.upper()}</div></article></body>"
    text = main_text.extract(page)[0]
    assert text.count("a sentence of the story") == 16 and "STORY" not in text


def test_quality_scores_by_loops(make):
    """The vectorised score of a model against a loop over each text's features."""
    import types

    model = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    rows = [(1, "ab abc ab"), (2, ""), (3, None), (4, "Één twee twee drie"), (5, "x")]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "text"])
    found = next(quality._score([batch], types.SimpleNamespace(value=model))).column(1).to_pylist()
    taught = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([0] * 5)], ["id", "text", "label"])
    for (_, text), score, keys, times in zip(rows, found, *(next(quality._features([taught])).column(k).to_pylist() for k in (1, 2))):
        assert score == pytest.approx(1 / (1 + np.exp(-sum(model[k] * t for k, t in zip(keys, times)))), abs=1e-5)
        words = WORD.findall((text or "").lower())
        runs = sum(max(0, len(w) + 2 - n + 1) for w in words for n in (3, 4, 5))
        assert sum(round(t * (1 + len(words) + max(0, len(words) - 1) + runs)) for t in times) == 1 + len(words) + max(0, len(words) - 1) + runs


def test_toxicity_gradient():
    r = np.random.default_rng(3)
    text_of = np.repeat(np.arange(6), 4)
    row, clue = r.integers(0, 24, 40), r.integers(0, 5, 40)
    label, weight, bias = np.array([1, 0, 1, 0, 0, 1]), r.normal(size=5), -0.7
    gradient = toxicity.slope(weight, bias, label, row, text_of, clue)[1]
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        up, down = (toxicity.slope(weight + s * step[:5], bias + s * step[5], label, row, text_of, clue)[0] for s in (1, -1))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_fixed_spans(spark, data, docs):
    for r in registry.queries()["op9_pii"](spark, data).collect():
        plain = plain_spans(docs[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert set(filter(None, plain.split(","))) <= set(r["spans"].split(","))


def test_learned_spans(make):
    """Phones after 'call me at' teach the pattern, which then finds one without a plus; other numbers are left."""
    rows = [(k, f"hello w{k} call me at +1 (202) 555-01{k:02d} soon ok") for k in range(40)]
    rows += [(100, "hello call me at (202) 555-0199 soon ok"), (101, "the total was (202) 555-0198 in all")]
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(make(rows))).collect()}
    assert found[100] == "phone:17:31" and found[101] == ""


def test_odd_rows(make, odd_rows, spark):
    docs = make(odd_rows)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 0), (6, 0, 1), (6, 0, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    n = len(odd_rows)
    ids = ids_of([t for _, t in odd_rows])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs.coalesce(1)).collect()) == Counter((i, len(x)) for (i, _), x in zip(odd_rows, ids))
    packed = packing.digest(packing.pack(docs.filter("doc_id <> 6"))).collect()
    check_packing(packed, {i: [*x, 0] for (i, _), x in zip(odd_rows, ids) if i not in (None, 6)})
    assert lm_score.score(docs).count() == n
    assert quality.score(docs, labels).count() == n
    tox = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    assert len(tox) == n - 1 and tox[1] == tox[2] == 0.0
    assert pii.digest(pii.find(docs)).filter("spans = ''").count() == n
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, "u", "<p>hi", "x")], "page_id bigint, url string, html string, text string")
    assert sorted(r["text"] for r in main_text.extract_pages(pages).collect()) == ["", "", "", "hi"]


def test_empty_tables(make, spark):
    none = make([]).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for out in (lm_score.score(none), quality.score(none, labels), toxicity.score(none, labels), packing.pack(none), token_counts.count_tokens(none), pii.digest(pii.find(none))):
        assert out.count() == 0
    some = make([(1, "hello there")])
    assert [r["score"] for r in quality.score(some, labels).collect()] == [0.5]
    assert [r["score"] for r in toxicity.score(some, labels).collect()] == pytest.approx([0.0])
