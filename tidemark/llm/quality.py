"""Quality scores of documents from averaged subword embeddings.

A document is the mean of the vectors of its features: its words, the
characters of its words in runs of three to five, and its pairs of neighbouring
words, a word that follows itself being one feature whatever the word.  All are
hashed to rows of one matrix.  A softmax over two classes reads the mean.  The
matrix is learned by stochastic gradient descent in numpy on a bounded sample of
labelled rows.  As the output is linear in the mean, scoring needs one number
for each row of the matrix, and a batch's distinct words are looked up once.

Defined cases: a null or empty text has only the feature that every text has
and so a score of its own; texts of any length are read whole; repeated rows
are scored each for itself; a null id is held out of no fold; labels that are
null or whose id is unknown teach nothing, and without any label every score is
0.5; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import sample
from ._shared import fold, map_batches
from ._words import Words, hash_ranges, mix, split_words, text_pieces

#: Rows of the matrix, its width, and labelled rows that it is learned from at most.
BUCKETS, WIDTH, MOST_ROWS = 1 << 17, 8, 4000
EPOCHS, RATE = 12, 0.4
_PAIR, _SAME, _EVERY = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), 0


def _bucket(h: np.ndarray) -> np.ndarray:
    return (1 + h % np.uint64(BUCKETS - 1)).astype(np.int64)


def _subwords(words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character runs of the words numbered ``first``, and the place in ``first`` of each."""
    data = b"".join(b"<" + words.data[s:e] + b">" for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True))
    raw = np.frombuffer(data, np.uint8)
    size = words.end[first] - words.start[first] + 2
    begin = np.flatnonzero((raw & 0xC0) != 0x80)
    word = np.searchsorted(np.cumsum(size), begin, side="right")
    stop = np.append(begin, len(raw))
    out, owner = [], []
    for n in (3, 4, 5):
        at = np.arange(len(begin) - n + 1) if len(begin) >= n else np.zeros(0, np.int64)
        at = at[word[at] == word[at + n - 1]]
        out.append(hash_ranges(data, stop[at], stop[at + n]))
        owner.append(word[at])
    return _bucket(mix(np.concatenate(out) ^ _PAIR)), np.concatenate(owner)


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words, and the text of each."""
    text = words.text_id
    at = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    a, b = words.hash[at], words.hash[at + 1]
    return _bucket(np.where(a == b, _SAME, mix((a ^ _PAIR) * _SAME + b))), text[at]


def _features(batches):
    """(id, label, buckets, times) of each text."""
    for batch in batches:
        for first, end, data, offsets in text_pieces(batch.column(1), 1 << 20):
            words = split_words(data, offsets)
            one, head, back = np.unique(words.hash, return_index=True, return_inverse=True)
            sub, owner = _subwords(words, head) if len(one) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(owner, kind="stable")
            sub, bounds = sub[order], np.searchsorted(owner[order], np.arange(len(one) + 1))
            pair, of = _pairs(words)
            cut = np.searchsorted(of, np.arange(end - first + 1))
            keys, times = [], []
            for k in range(end - first):
                own = back[words.of_text[k] : words.of_text[k + 1]]
                runs = [sub[bounds[w] : bounds[w + 1]] for w in own]
                all_ = np.concatenate([[_EVERY], _bucket(one[own]), pair[cut[k] : cut[k + 1]], *runs])
                key, count = np.unique(all_, return_counts=True)
                keys.append(key.astype(np.int32))
                times.append((count / len(all_)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(first, end - first), pa.array(keys, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.float32()))], ["label", "keys", "times"])


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> np.ndarray:
    """One number for each bucket: the difference of the two outputs of its vector.

    Descent by the gradient of one document's loss at a time; a row's steps
    shrink with the squares of the gradients that it has had (AdaGrad).
    """
    random = np.random.default_rng(seed)
    matrix = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    output = np.zeros((2, WIDTH), np.float32)
    seen, seen_output = np.full(BUCKETS, 1e-8, np.float32), np.full((2, 1), 1e-8, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(rows)):
            label, keys, times = rows[k]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            own = matrix[keys]
            mean = times @ own
            z = output @ mean
            z -= z.max()
            error = np.exp(z) / np.exp(z).sum()
            error[label] -= 1
            down = error @ output
            slope = np.outer(error, mean)
            seen_output += (slope * slope).mean(axis=1, keepdims=True)
            seen[keys] += times * times * (down @ down / WIDTH)
            output -= rate * slope / np.sqrt(seen_output)
            matrix[keys] = own - (rate * times / np.sqrt(seen[keys]))[:, None] * down
    return (matrix @ (output[1] - output[0])).astype(np.float32)


def train(labelled: DataFrame) -> np.ndarray:
    """The numbers of all buckets, from (id, text, label)."""
    found = map_batches(labelled.select("id", "text", "label"), _features, "label int, keys array<int>, times array<float>").toArrow()
    rows = [(int(label), keys.values.to_numpy(), times.values.to_numpy()) for label, keys, times in zip(found["label"].to_pylist(), found["keys"], found["times"], strict=True)]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return learn(rows) if rows else np.zeros(BUCKETS, np.float32)


def _score(batches, model):
    value = model.value.astype(np.float64)
    for batch in batches:
        out = np.zeros(len(batch))
        for first, end, data, offsets in text_pieces(batch.column(1)):
            words, n = split_words(data, offsets), end - first
            total, count = np.full(n, value[_EVERY]), np.ones(n)
            if len(words.hash):
                one, head, back = np.unique(words.hash, return_index=True, return_inverse=True)
                sub, owner = _subwords(words, head)
                gain = value[_bucket(one)] + np.bincount(owner, value[sub], len(one))
                size = 1 + np.bincount(owner, minlength=len(one))
                text = words.text_id
                pair, of = _pairs(words)
                total += np.bincount(text, gain[back], n) + np.bincount(of, value[pair], n)
                count += np.bincount(text, size[back], n) + np.bincount(of, minlength=n)
            out[first:end] = 1 / (1 + np.exp(-total / count))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])


def score(docs: DataFrame, labels: DataFrame, use: Column | None = None, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; learns ``labels.quality`` from rows where ``use`` holds."""
    model = train(sample(docs, labels, "quality", F.lit(True) if use is None else use, most_rows, id_col, text_col))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(own, partial(_score, model=held), f"id {kind}, score double").withColumnRenamed("id", id_col)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
#: A learned score is not SQL's; tests hold it against held-out labels.
ORACLE_SQL: dict[str, str] = {}
