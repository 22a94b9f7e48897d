"""Toxicity of documents by multiple-instance learning over their sentences.

Only documents have labels.  A sentence has the probability
``sigmoid(bias + sum of the weights of its distinct clues)`` and a document is
toxic if any sentence is: ``1 - prod(1 - p)``, the noisy-or.  The weights are
learned from the documents' labels through the noisy-or, so the blame falls on
the sentences that set toxic documents apart, and those sentences can be named.

A sentence ends with a word that ends in ``.``, ``!`` or ``?`` (quotes and
brackets may follow) or at a line break.  Clues are words in lower case (A-Z)
without ASCII punctuation at either end, and the beginnings of longer words;
those take part that toxic texts have more often than chance allows.

Defined cases: a null or empty text, or one without words, has no sentence and
a score of 0; texts of any length are read whole; repeated rows are scored each
for itself; ties for the worst sentence go to the first; labels that are null or
whose id is unknown teach nothing; without labels of both kinds every sentence
has a probability of 0; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import sample
from ._shared import fold, map_batches, written
from ._words import Words, hash_ranges, split_words, text_pieces

#: Labelled rows to learn from at most, labelled texts that a clue must be in, and steps of descent.
MOST_ROWS, LEAST_TEXTS, STEPS = 12_000, 3, 200
#: Bytes of the beginnings of words that are clues beside whole words.
STEMS = (4, 5, 6)
#: Score from which a document counts as toxic.
REJECT = 0.3

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each word, numbered over all texts; hash and byte range of each bare word)."""
    raw = np.frombuffer(words.data + b"\0", np.uint8)
    start, end = words.start.copy(), words.end.copy()
    stops = np.zeros(len(start), bool)
    live = np.arange(len(start))
    while len(live):
        live = live[_PUNCTUATION[raw[end[live] - 1]] & (end[live] > start[live])]
        stops[live] |= _STOP[raw[end[live] - 1]]
        end[live] -= 1
    live = np.arange(len(start))
    while len(live):
        live = live[_PUNCTUATION[raw[start[live]]] & (end[live] > start[live])]
        start[live] += 1
    lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])[words.start]
    text = words.text_id
    new = np.ones(len(start), bool)
    new[1:] = stops[:-1] | (lines[1:] != lines[:-1]) | (text[1:] != text[:-1])
    return np.cumsum(new) - 1, hash_ranges(words.data, start, end), start, end


def _clues(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(clue, number of the word): each bare word and the beginnings of longer words, as 32-bit hashes."""
    start, end = np.asarray(start), np.asarray(end)
    out, owner = [hash_ranges(data, start, end)], [np.arange(len(start))]
    for n in STEMS:
        longer = np.flatnonzero(end - start > n)
        out.append(hash_ranges(data, start[longer], start[longer] + n) ^ np.uint64(n))
        owner.append(longer)
    return (np.concatenate(out) >> np.uint64(32)).astype(np.uint32), np.concatenate(owner)


def _distinct(data: bytes, offsets: np.ndarray):
    """(words, sentence of each word, number of its bare form, clues and the bare forms that they belong to)."""
    words = split_words(data, offsets)
    sentence, bare, start, end = sentences(words)
    _, head, back = np.unique(bare, return_index=True, return_inverse=True)
    clue, owner = _clues(words.data, start[head], end[head])
    return words, sentence, back, clue, owner


def _all_clues(batches):
    """(label, distinct clues) of each text."""
    for batch in batches:
        for first, end, data, offsets in text_pieces(batch.column(1), 1 << 20):
            words, _, back, clue, owner = _distinct(data, offsets)
            order = np.argsort(owner, kind="stable")
            clue, cut = clue[order], np.searchsorted(owner[order], np.arange(owner.max() + 2 if len(owner) else 1))
            found = []
            for k in range(end - first):
                own = np.unique(back[words.of_text[k] : words.of_text[k + 1]])
                found.append(np.unique(np.concatenate([clue[cut[w] : cut[w + 1]] for w in own])).view(np.int32) if len(own) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(first, end - first), pa.array(found, pa.list_(pa.int32()))], ["label", "clues"])


def _in_sentences(words, sentence, back, clue, owner, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, number of a known clue), each once."""
    place = np.minimum(np.searchsorted(known, clue), max(len(known) - 1, 0))
    hit = np.flatnonzero(known[place] == clue) if len(known) else np.zeros(0, np.int64)
    order = np.argsort(owner[hit], kind="stable")
    hit = hit[order]
    low, high = np.searchsorted(owner[hit], back), np.searchsorted(owner[hit], back, side="right")
    many = high - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(back) else np.zeros(0, np.int64)
    pairs = np.unique(np.repeat(sentence, many) * np.int64(max(len(known), 1)) + place[hit[at]])
    return pairs // max(len(known), 1), pairs % max(len(known), 1)


def _bags(batches, known):
    """(id, label, sentences, sentence and number of each known clue) of each text."""
    for batch in batches:
        for first, end, data, offsets in text_pieces(batch.column(1)):
            words, sentence, *rest = _distinct(data, offsets)
            of, clue = _in_sentences(words, sentence, *rest, known)
            text = words.text_id
            head = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.zeros(0, np.int64)
            many = np.bincount(text[head], minlength=end - first)
            begin = np.concatenate([[0], np.cumsum(many)])
            cut = np.searchsorted(of, begin).astype(np.int32)
            of = of - np.repeat(begin[:-1], np.diff(cut))
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (of, clue)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(many), *lists], ["id", "label", "n", "sentences", "clues"])


def telling(clue: np.ndarray, n: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Sorted clues that toxic texts have more often than chance allows.

    ``n`` texts have the clue, ``toxic`` of them are toxic and ``rate`` of all
    are.  Of all clues one at most would pass by chance: the probability of as
    many toxic texts among those that have the clue is bounded (Chernoff) by
    1 / number of clues.
    """
    if not len(clue) or not 0 < rate < 1:
        return np.zeros(0, np.uint32)
    share = np.clip(toxic / n, 1e-9, 1 - 1e-9)
    bound = n * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    return np.sort(clue[(share > rate) & (bound >= np.log(len(clue) + 1))])


def slope(weight: np.ndarray, bias: float, label: np.ndarray, row: np.ndarray, text_of: np.ndarray, clue: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean loss of the noisy-or over documents, and its gradient by the weights and the bias.

    ``row`` and ``clue`` are pairs of a sentence and a clue in it, ``text_of`` the text of each sentence.
    """
    n, total = len(label), len(text_of)
    p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weight[clue], total), -30, 30)))
    none = np.exp(np.bincount(text_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
    any_ = np.maximum(1 - none, 1e-6)
    loss = -np.where(label == 1, np.log(any_), np.log(np.maximum(none, 1e-300))).mean()
    down = p * np.where(label == 1, -none / any_, 1.0)[text_of]
    return float(loss), np.append(np.bincount(clue, down[row], len(weight)), down.sum()) / n


def learn(label: np.ndarray, n_sentences: np.ndarray, text: np.ndarray, sentence: np.ndarray, clue: np.ndarray, n_clues: int) -> tuple[np.ndarray, float]:
    """(weights, bias) from rows of (text, sentence, clue); ``label`` and ``n_sentences`` are by text.

    Descent with step sizes by weight (Adam) on the mean loss of the noisy-or
    and a small ridge.
    """
    if not n_clues:
        return np.zeros(0), -np.inf
    begin = np.concatenate([[0], np.cumsum(n_sentences)])
    row = begin[text] + sentence
    text_of = np.repeat(np.arange(len(label)), n_sentences)
    weight, bias = np.zeros(n_clues), -6.0
    moment, square = np.zeros(n_clues + 1), np.zeros(n_clues + 1)
    for step in range(1, STEPS + 1):
        gradient = slope(weight, bias, label, row, text_of, clue)[1]
        gradient[:-1] += 2e-5 * weight
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        change = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weight -= change[:-1]
        bias -= change[-1]
    return weight, float(bias)


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column."""
    lists = table[name].combine_chunks()
    if not len(lists):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)


def train(labelled: DataFrame):
    """(sorted clues, weights, bias) from (id, text, label)."""
    held = written(labelled.select(F.col("id").cast("string").alias("id"), "text", "label"), "labelled")
    found = map_batches(held, _all_clues, "label int, clues array<int>").select("label", F.explode("clues").alias("clue"))
    often = found.groupBy("clue").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).filter(F.col("n") >= LEAST_TEXTS).toArrow()
    rate = held.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    known = telling(often["clue"].to_numpy().view(np.uint32), *(often[c].to_numpy().astype(float) for c in ("n", "toxic")), rate)
    bags = map_batches(held, partial(_bags, known=known), "id string, label int, n bigint, sentences array<int>, clues array<int>").toArrow().sort_by("id")
    text, sentence = _flat(bags, "sentences")
    weight, bias = learn(bags["label"].to_numpy(), bags["n"].to_numpy(), text, sentence, _flat(bags, "clues")[1], len(known))
    return known, weight, bias


def _score(batches, model):
    known, weight, bias = model.value
    for batch in batches:
        n = len(batch)
        score, worst, begin, stop, many = np.zeros(n), np.zeros(n), np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
        for first, end, data, offsets in text_pieces(batch.column(1)):
            words, sentence, *rest = _distinct(data, offsets)
            if not len(sentence):
                continue
            of, clue = _in_sentences(words, sentence, *rest, known)
            n_sentences = int(sentence[-1]) + 1
            logit = bias + (np.bincount(of, weight[clue], n_sentences) if len(of) else np.zeros(n_sentences))
            p = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            head = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
            tail = np.append(head[1:], len(sentence)) - 1
            text = words.text_id[head]
            score[first:end] = -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), end - first))
            order = np.lexsort((np.arange(n_sentences), -p, text))
            top = order[np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1]]))]
            rows = first + text[top]
            worst[rows], many[first:end] = p[top], np.bincount(text, minlength=end - first)
            points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            base = points[offsets[text[top]]]
            begin[rows], stop[rows] = points[words.start[head[top]]] - base, points[words.end[tail[top]]] - base
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (score, many, worst, begin, stop))], ["id", "score", "n_sentences", "worst_score", "worst_start", "worst_end"])


def score(docs: DataFrame, labels: DataFrame, use: Column | None = None, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_sentences, worst_score, worst_start, worst_end) of every row.

    The worst sentence is given by code points of the text, its end exclusive;
    -1 where there is none.  Learns ``labels.toxic`` from rows where ``use`` holds.
    """
    model = train(sample(docs, labels, "toxic", F.lit(True) if use is None else use, most_rows, id_col, text_col))
    return _apply(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model).withColumnRenamed("id", id_col)


def _apply(texts: DataFrame, model) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(model)
    return map_batches(texts, partial(_score, model=held), f"id {dict(texts.dtypes)['id']}, score double, n_sentences bigint, worst_score double, worst_start bigint, worst_end bigint")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, with all their columns, as they pass; nothing is shuffled but the labelled sample."""
    model = train(sample(docs, labels, "toxic", F.lit(True), MOST_ROWS, id_col, text_col))
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index(text_col)
    return map_batches(docs, partial(_keep, model=held, text=text, threshold=threshold), docs.schema)


def _keep(batches, model, text: int, threshold: float):
    for batch in batches:
        own = pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch.column(text).cast(pa.string())], ["id", "text"])
        score = next(_score([own], model)).column(1)
        yield batch.filter(pc.less(score, threshold))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 4) == 2
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "n_sentences", "worst_score", "worst_start", "worst_end")


QUERIES = {"op7_toxicity": op7_toxicity}
#: A learned score is not SQL's; tests hold it against held-out labels.
ORACLE_SQL: dict[str, str] = {}
