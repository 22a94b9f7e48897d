"""Language-model scores by a weighted backoff automaton.

All runs of one, two and three words of all training texts are counted exactly,
by map-side sums and a shuffle.  The model holds every word, and every longer
run that was met at least ``LEAST`` times, at any size of the corpus.

The automaton's states are the empty context, words and pairs of words; an arc
carries the log10 probability of a word after a context (absolute discounting),
a failure arc the backoff weight to the next shorter context.  Each text is read
once from left to right: the state moves along an arc, or along failure arcs
until there is one, and the weights add up.  All texts of a batch move a word at
a time.

No task holds the whole automaton and nothing of it is broadcast.  Texts are
written as chunks of about a million tokens.  Most longer runs are met once in
the whole corpus, so a chunk first sends two bytes for each of its distinct runs
(where its hash lies in its bucket) and learns which of them another chunk may
have too; a run that no other chunk has and that it counts less than twice can't
be in the model.  A chunk then sends its words and the runs that are left with
its own counts to buckets of their hashes, and gets back the counts over all
chunks; it then sends the contexts of its runs and gets back their failure
weights.  What it has then is the part of the automaton that its
texts can reach, and it reads them with that.  A run adds to the sums of its
context once, in the first chunk that has it.  A bucket gets a run at most once
from a chunk, however common it is, and the number of buckets follows the text.

The empty context has an arc for every word of the corpus, (c + 1) / (N + V + 1),
and one of 1 / (N + V + 1) for all others.

A text's tokens are its words and one end, and it begins in the state after an
end.  Words and runs are 64-bit hashes.

Defined cases: a null text is an empty text, whose only token is the end; a
null id belongs to the training fold; repeated rows are counted and scored each
for itself; with an empty training fold every probability is 1; further columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, fold, map_batches
from ._words import Words, mix, split_words, text_pieces

#: The end's place among the hashes of words.
END = np.uint64(0xE11D0F7E47000001)
#: Times that a run of two or three words is met, at least, to be in the model.
LEAST, DISCOUNT = 2, 0.5
#: Tokens of a chunk, at least, unless it is a task's last; and of all texts for each bucket.
CHUNK, BUCKET = 1_200_000, 250_000
#: Bits that tell a run's place in its bucket; files that chunks are dealt to at least, and bytes of text for each file beyond that.
PLACE_BITS, FILES, FILE_BYTES = 24, 48, 32 << 20
PIECE_BYTES = 1 << 20
_SALT2, _SALT3, _STEP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0x9E3779B97F4A7C15)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, by a sort: numpy's own, without places, goes by a hash table, which takes many times that."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(len(keys[:1]), bool), keys[1:] != keys[:-1]])]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and each key's place among them, by one sort of keys whose low bits give way to their rows."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    row = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    own = keys[row]
    if (own[1:] < own[:-1]).any():  # keys that differ in the low bits only
        return np.unique(keys, return_inverse=True)
    new = np.concatenate([np.ones(len(own[:1]), bool), own[1:] != own[:-1]])
    place = np.empty(len(own), np.int64)
    place[row] = np.cumsum(new) - 1
    return own[new], place


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end after each text, and the range of each text."""
    token = np.insert(words.hash, words.of_text[1:], END)
    return token, words.of_text + np.arange(len(words.of_text))


def _chunks(batches, size: int):
    """Texts as chunks: their ids and folds, distinct word hashes, and tokens as places among those."""
    task, number = TaskContext.get().partitionId() << 33, 0
    held: list[tuple] = []
    tokens = 0

    def close() -> pa.RecordBatch:
        words, token = _ranked(np.concatenate([x[0] for x in held]))
        of_text = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in held]))])
        ids, folds = pa.concat_arrays([x[2] for x in held]), pa.concat_arrays([x[3] for x in held])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        trained = int(np.diff(of_text)[_trained(folds)].sum())
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([task + number]), one(ids), one(folds), pa.array([len(token)]), pa.array([trained]), *(pa.array([x], pa.binary()) for x in (words.tobytes(), _thin(token, len(words)), of_text.tobytes()))],
            ["chunk", "ids", "folds", "n_tokens", "n_train", "words", "token", "of_text"],
        )

    for batch in batches:
        for first, end, data, offsets in text_pieces(batch.column(2), PIECE_BYTES):
            token, of_text = _tokens(split_words(data, offsets))
            held.append((token, of_text, batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first)))
            tokens += len(token)
            if tokens >= size:
                yield close()
                number, tokens = number + 1, 0
    if held:
        yield close()


def _thin(token: np.ndarray, words: int) -> bytes:
    """Numbers of words in three bytes each, where these hold them."""
    wide = token.astype("<u4").view(np.uint8).reshape(-1, 4)
    return wide[:, : 3 if words <= 1 << 24 else 4].tobytes()


def _thick(raw: pa.Buffer, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    flat = np.frombuffer(raw, np.uint8).reshape(n, -1)
    out[:, : flat.shape[1]] = flat
    return out.view("<u4").ravel().astype(np.int64)


def _trained(folds: pa.Array) -> np.ndarray:
    return ~folds.fill_null(True).to_numpy(zero_copy_only=False)


class Text:
    """A chunk's tokens and the keys of the runs that end at each."""

    def __init__(self, row: pa.Table):
        flat = lambda name, kind: np.frombuffer(row.column(name)[0].as_buffer(), kind)
        self.chunk = row.column("chunk")[0].as_py()
        self.ids, self.folds = row.column("ids")[0].values, row.column("folds")[0].values
        self.words, self.of_text = flat("words", np.uint64), flat("of_text", np.int64)
        self.token = _thick(row.column("token")[0].as_buffer(), row.column("n_tokens")[0].as_py())
        first = self.of_text[:-1]
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[first] = np.searchsorted(self.words, END)
        self.two = mix((self.words[self.before] ^ _SALT2) * _STEP + self.words[self.token])
        inner = np.ones(len(self.two), bool)
        inner[first] = False
        self.inner = np.flatnonzero(inner)
        self.three = mix((self.two[self.inner - 1] ^ _SALT3) * _STEP + self.words[self.token[self.inner]])


class Runs(Text):
    """The distinct runs of a chunk's texts: their keys, sorted, and where each stands."""

    def __init__(self, row: pa.Table):
        super().__init__(row)
        before, two, three = self.before, self.two, self.three
        self.pairs, self.pair = _ranked(two)
        self.triples, self.triple = _ranked(three)
        at = np.empty(len(self.pairs), np.int64)
        at[self.pair] = np.arange(len(two))
        self.a, self.b = before[at], self.token[at]  # the words of each pair
        at = np.empty(len(self.triples), np.int64)
        at[self.triple] = self.inner
        self.context, self.below, self.c = self.pair[at - 1], self.pair[at], self.token[at]  # the two pairs of each triple, and its last word

    def trained(self) -> list[np.ndarray]:
        """How often each word, pair and triple is met in the chunk's training texts."""
        use = np.repeat(_trained(self.folds), np.diff(self.of_text))
        return [np.bincount(self.token[use], minlength=len(self.words)), np.bincount(self.pair[use], minlength=len(self.pairs)), np.bincount(self.triple[use[self.inner]], minlength=len(self.triples))]

    def shared(self, replies: pa.Table, counts: list[np.ndarray]) -> list[np.ndarray]:
        """Pairs and triples that may be met twice."""
        bits = _gather(replies, 0, _bits) or [np.zeros(0, bool)] * 2
        return [bit | (count >= LEAST) for bit, count in zip(bits, counts[1:], strict=True)]

    def asked(self, counts: list[np.ndarray]) -> list[np.ndarray]:
        """Words and pairs that can be contexts."""
        return [counts[0] >= LEAST, counts[1] >= LEAST]


def _small(x: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for one of the larger ones, which follow."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<u8").tobytes()


def _wide(raw: pa.Buffer, sizes: list[int]) -> np.ndarray:
    n = sum(sizes)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n)
    return out


def _short(keys: np.ndarray, buckets: int) -> bytes:
    """Keys of one bucket without the high bytes in which they hardly differ: with 256 buckets or more, the rest is unique in a bucket."""
    width = 8 - (buckets.bit_length() - 1) // 8
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _long(raw: pa.Buffer, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    flat = np.frombuffer(raw, np.uint8).reshape(n, -1)
    out[:, : flat.shape[1]] = flat
    return out.view("<u8").ravel()


def _full(runs: Runs, found: list[np.ndarray], shared: list[np.ndarray]) -> list[np.ndarray]:
    """Replies for words, pairs and triples; 0 for runs that weren't asked."""
    out = [found[0]]
    for values, use in zip(found[1:], shared, strict=True):
        out.append(np.zeros(len(use), values.dtype))
        out[-1][use] = values
    return out


def _deal(keys: list[np.ndarray], buckets: int):
    """(bucket, range of each of the sorted arrays) of every bucket that has keys."""
    place = [((k >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(40) for k in keys]
    ends = [np.searchsorted(p, np.arange(buckets + 1, dtype=np.uint64)) for p in place]
    for k in np.flatnonzero(sum(np.diff(e) for e in ends)):
        yield int(k), [slice(e[k], e[k + 1]) for e in ends]


def _in_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys lie in their bucket, in PLACE_BITS bits; in the keys' order."""
    return ((keys >> np.uint64(24)) * np.uint64(buckets) & np.uint64((1 << 40) - 1)) >> np.uint64(40 - PLACE_BITS)


def _steps(place: np.ndarray) -> bytes:
    """Places in order as steps of two bytes; 65535 is a step that isn't the last to its place."""
    step = np.diff(place.astype(np.int64), prepend=0)
    last = np.cumsum(step // 65535 + 1) - 1
    out = np.full(int(last[-1]) + 1 if len(last) else 0, 65535, "<u2")
    out[last] = step % 65535
    return out.tobytes()


def _places(raw: pa.Buffer) -> np.ndarray:
    step = np.frombuffer(raw, "<u2")
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def _bits(raw: pa.Buffer, sizes: list[int]) -> np.ndarray:
    flat, cut = np.frombuffer(raw, np.uint8), -(-sizes[0] // 8)
    return np.concatenate([np.unpackbits(flat[:cut])[: sizes[0]], np.unpackbits(flat[cut:])[: sizes[1]]]).astype(bool)


def _hint(batches, buckets: int):
    """The places of a chunk's distinct pairs and triples, for each bucket."""
    for batch in batches:
        for k in range(batch.num_rows):
            text = Text(pa.Table.from_batches([batch.slice(k, 1)]))
            keys = [_distinct(text.two), _distinct(text.three)]
            rows = [(bucket, [x.stop - x.start for x in own], *(_steps(_in_bucket(v[x], buckets)) for v, x in zip(keys, own, strict=True))) for bucket, own in _deal(keys, buckets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([text.chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                ["bucket", "chunk", "sizes", "two", "three"],
            )


def _met(table: pa.Table) -> pa.Table:
    """To every chunk whether each of its runs' places is met twice or more."""
    bits = []
    for name in ("two", "three"):
        place = [_places(x.as_buffer()) for x in table.column(name)]
        often = np.bincount(np.concatenate(place), minlength=1 << PLACE_BITS) if sum(map(len, place)) > 1 << (PLACE_BITS - 3) else None
        if often is None:
            one, back, count = np.unique(np.concatenate(place), return_inverse=True, return_counts=True)
            again = np.split(count[back] > 1, np.cumsum([len(x) for x in place])[:-1])
        else:
            again = [often[x] > 1 for x in place]
        bits.append([np.packbits(x).tobytes() for x in again])
    return _reply(table, 0, [a + b for a, b in zip(*bits, strict=True)], [0] * table.num_rows)


def _gather(replies: pa.Table, kind: int, decode) -> list[np.ndarray]:
    """The replies to a chunk in the order of its own sorted keys."""
    own = sorted((r for r in range(replies.num_rows) if replies.column("kind")[r].as_py() == kind), key=lambda r: replies.column("bucket")[r].as_py())
    parts: list[list] = []
    for r in own:
        sizes = replies.column("sizes")[r].as_py()
        value = decode(replies.column("value")[r].as_buffer(), sizes)
        parts.append(np.split(value, np.cumsum(sizes)[:-1]))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _send(chunk: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """What a chunk's training texts count of its words and of runs that may be met twice, for each bucket."""
    runs = Runs(chunk)
    counts = runs.trained()
    shared = runs.shared(replies, counts)
    keys = [runs.words, *(k[x] for k, x in zip((runs.pairs, runs.triples), shared, strict=True))]
    counts = [counts[0], *(c[x] for c, x in zip(counts[1:], shared, strict=True))]
    rows = [
        (bucket, [x.stop - x.start for x in own], _short(np.concatenate([v[x] for v, x in zip(keys, own, strict=True)]), buckets), _small(np.concatenate([v[x] for v, x in zip(counts, own, strict=True)])))
        for bucket, own in _deal(keys, buckets)
    ]
    return pa.table(
        {
            "bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([runs.chunk] * len(rows), pa.int64()), "sizes": pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            "keys": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary()),
        }
    )


def _in_order(table: pa.Table) -> tuple[pa.Table, list[list[int]], np.ndarray, np.ndarray]:
    """A bucket's rows by chunk, their sizes, all their keys as places among the distinct ones, and the ends of rows."""
    table = table.take(pa.array(np.argsort(table.column("chunk").to_numpy())))
    sizes = table.column("sizes").to_pylist()
    keys = np.concatenate([_long(x.as_buffer(), sum(s)) for x, s in zip(table.column("keys"), sizes, strict=True)])
    return table, sizes, np.unique(keys, return_inverse=True)[1], np.cumsum([sum(s) for s in sizes])


def _reply(table: pa.Table, kind: int, values: list[bytes], words: list[int]) -> pa.Table:
    n = table.num_rows
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "kind": pa.array(np.full(n, kind, np.int8)), "sizes": table.column("sizes"), "value": pa.array(values, pa.binary()), "words": pa.array(words, pa.int64())})


def _count(table: pa.Table) -> pa.Table:
    """To every chunk twice the count of each of its keys over all chunks, and 1 more in the first chunk that counts it."""
    table, sizes, key, ends = _in_order(table)
    count = np.concatenate([_wide(x.as_buffer(), s) for x, s in zip(table.column("counts"), sizes, strict=True)])
    total = np.bincount(key, count).astype(np.int64)
    counted = np.flatnonzero(count)[::-1]
    first = np.full(len(total), -1)
    first[key[counted]] = counted  # the last that is put there is the first of them
    value = total[key] << 1
    value[first[first >= 0]] += 1
    parts = np.split(value, ends[:-1])
    return _reply(table, 1, [_small(x) for x in parts], [int((x[: s[0]] & 1).sum()) for x, s in zip(parts, sizes, strict=True)])


def _sums(chunk: pa.Table, replies: pa.Table, buckets: int, z: int) -> pa.Table:
    """What the runs that a chunk is the first to count add to the sums of their contexts."""
    runs = Runs(chunk)
    found = _full(runs, _gather(replies, 1, _wide), runs.shared(replies, runs.trained()))
    counts, first = [x >> 1 for x in found], [(x & 1).astype(bool) for x in found]
    asked = runs.asked(counts)
    p1 = (counts[0] + 1) / z
    p2 = np.maximum(counts[1] - DISCOUNT, 0) / np.maximum(counts[0][runs.a], 1)
    use = first[1] & (counts[1] >= LEAST)
    own = [np.bincount(runs.a[use], p2[use], len(runs.words))]
    low = [np.bincount(runs.a[use], p1[runs.b[use]], len(runs.words))]
    use = first[2] & (counts[2] >= LEAST)
    p3 = (counts[2][use] - DISCOUNT) / counts[1][runs.context[use]]
    own.append(np.bincount(runs.context[use], p3, len(runs.pairs)))
    low.append(np.bincount(runs.context[use], p2[runs.below[use]], len(runs.pairs)))
    keys = [k[x] for k, x in zip((runs.words, runs.pairs), asked, strict=True)]
    own, low = ([v[x] for v, x in zip(side, asked, strict=True)] for side in (own, low))
    rows = []
    for bucket, at in _deal(keys, buckets):
        key, more, less = (np.concatenate([v[x] for v, x in zip(side, at, strict=True)]) for side in (keys, own, low))
        adds = np.flatnonzero(more)
        rows.append((bucket, [x.stop - x.start for x in at], _short(key, buckets), adds.astype("<i4").tobytes() + more[adds].tobytes() + less[adds].tobytes()))
    return pa.table(
        {
            "bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([runs.chunk] * len(rows), pa.int64()), "sizes": pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            "keys": pa.array([r[2] for r in rows], pa.binary()), "adds": pa.array([r[3] for r in rows], pa.binary()),
        }
    )


def _left(table: pa.Table) -> pa.Table:
    """Failure weights of contexts: the probability that their arcs leave over that which they cover below."""
    table, _, key, ends = _in_order(table)
    own, low = np.zeros(len(key)), np.zeros(len(key))
    for begin, adds in zip(np.concatenate([[0], ends[:-1]]), table.column("adds"), strict=True):
        raw = adds.as_buffer()
        n = len(raw) // 20
        at = begin + np.frombuffer(raw, "<i4", n)
        own[at], low[at] = np.frombuffer(raw, "<f8", n, 4 * n), np.frombuffer(raw, "<f8", n, 12 * n)
    own, low = np.bincount(key, own), np.bincount(key, low)
    weight = np.log10(np.maximum(1 - own, 1e-6) / np.maximum(1 - low, 1e-6))[key].astype("<f4")
    return _reply(table, 2, [x.tobytes() for x in np.split(weight, ends[:-1])], [0] * table.num_rows)


@dataclass
class Automaton:
    """States and arcs as arrays; state 0 is the empty context."""

    word: np.ndarray  # sorted hashes of words
    known: np.ndarray  # log10 of their probabilities after the empty context
    state_of: np.ndarray  # the state after a word alone
    arc: np.ndarray  # sorted state * 2^32 + word
    weight: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    backoff: np.ndarray

    @classmethod
    def of(cls, runs: Runs, counts: list[np.ndarray], left: list[np.ndarray], z: int) -> Automaton:
        """The states and arcs that a chunk's texts can reach."""
        one, two = runs.asked(counts)
        three = counts[2] >= LEAST
        state_of, pair_state = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
        state_of[one] = 1 + np.arange(one.sum())
        pair_state[two] = 1 + one.sum() + np.arange(two.sum())
        fail = np.concatenate([np.zeros(1 + one.sum(), np.int64), state_of[runs.b[two]]])
        p2 = (counts[1][two] - DISCOUNT) / counts[0][runs.a[two]]
        context, below = runs.context[three], runs.below[three]
        p3 = (counts[2][three] - DISCOUNT) / counts[1][context]
        arc = np.concatenate([state_of[runs.a[two]] << 32 | runs.b[two], pair_state[context] << 32 | runs.c[three]])
        order = np.argsort(arc)
        weight, target = np.log10(np.concatenate([p2, p3])), np.concatenate([pair_state[two], pair_state[below]])
        return cls(runs.words, np.log10((counts[0] + 1) / z), state_of, arc[order], weight[order], target[order], fail, np.concatenate([[0.0], *left]))

    def read(self, token: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        """Log10 probabilities of texts of word numbers."""
        size = np.diff(of_text)
        order = np.argsort(-size, kind="stable")
        at, size = of_text[:-1][order], size[order]
        ends = _place(self.word, np.array([END]))[0]
        state, total = np.full(len(size), self.state_of[ends]), np.zeros(len(size))
        active = len(size)
        for t in range(int(size[0]) if len(size) else 0):
            while size[active - 1] <= t:
                active -= 1
            word, now = token[at[:active] + t], state[:active]
            following = self.state_of[word]
            gain = self.known[word]
            inside = np.flatnonzero(now)
            while len(inside) and len(self.arc):
                key = now[inside] << 32 | word[inside]
                place = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                hit = self.arc[place] == key
                found = inside[hit]
                gain[found] = self.weight[place[hit]]
                following[found] = self.target[place[hit]]
                missed = inside[~hit]
                total[missed] += self.backoff[now[missed]]
                now[missed] = self.fail[now[missed]]
                inside = missed[now[missed] > 0]
            total[:active] += gain
            state[:active] = following
        out = np.empty(len(size))
        out[order] = total
        return out


def _place(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted array, -1 where it doesn't."""
    if not len(sorted_):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def _score(chunk: pa.Table, replies: pa.Table, z: int) -> pa.Table:
    runs = Runs(chunk)
    counts = [x >> 1 for x in _full(runs, _gather(replies, 1, _wide), runs.shared(replies, runs.trained()))]
    asked = runs.asked(counts)
    left = _gather(replies, 2, lambda raw, _: np.frombuffer(raw, "<f4").astype(float)) if any(x.any() for x in asked) else [np.zeros(0)] * 2
    auto = Automaton.of(runs, counts, left, z)
    n = len(runs.ids)
    text = np.repeat(np.arange(n), np.diff(runs.of_text))
    known = np.bincount(text, counts[0][runs.token] > 0, n).astype(np.int64)
    return pa.table(
        {
            "id": runs.ids, "held_out": runs.folds, "n_tokens": pa.array(np.diff(runs.of_text)), "n_known": pa.array(known),
            "base_score": pa.array(np.bincount(text, auto.known[runs.token], n)), "score": pa.array(auto.read(runs.token, runs.of_text)),
        }
    )


def score(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from rows where ``held_out`` is false."""
    own = docs.select(F.col(id_col).alias("id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["id"]
    schema = f"chunk bigint, ids array<{kind}>, folds array<boolean>, n_tokens bigint, n_train bigint, words binary, token binary, of_text binary"
    scratch = Scratch(docs.sparkSession)
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    chunks = scratch.write(map_batches(own, partial(_chunks, size=CHUNK), schema), "chunks", bucket_by="chunk", buckets=min(100_000, max(FILES, size // FILE_BYTES)))
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("train")).first()
    buckets = min(1 + size["tokens"] // BUCKET, (1 << 24) - 1)
    reply = "chunk bigint, bucket bigint, kind tinyint, sizes array<int>, value binary, words bigint"
    both = lambda replies: chunks.groupBy("chunk").cogroup(replies.groupBy("chunk"))  # noqa: E731  chunks stay where their bucket is
    hints = map_batches(chunks, partial(_hint, buckets=buckets), "bucket bigint, chunk bigint, sizes array<int>, two binary, three binary")
    met = scratch.write(hints.groupBy("bucket").applyInArrow(_met, reply), "met")
    sent = both(met).applyInArrow(lambda chunk, replies: _send(chunk, replies, buckets), "bucket bigint, chunk bigint, sizes array<int>, keys binary, counts binary")
    counts = scratch.write(sent.groupBy("bucket").applyInArrow(_count, reply), "counts")
    z = size["train"] + counts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] + 1
    counts = counts.unionByName(met)
    sums = both(counts).applyInArrow(lambda chunk, replies: _sums(chunk, replies, buckets, z), "bucket bigint, chunk bigint, sizes array<int>, keys binary, adds binary")
    left = scratch.write(sums.groupBy("bucket").applyInArrow(_left, reply), "left")
    out = both(counts.unionByName(left)).applyInArrow(lambda chunk, replies: _score(chunk, replies, z), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(size["train"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold("doc_id", 7) == 2)


QUERIES = {"op3_lm_score": op3_lm_score}
#: Tests hold the base columns and the score against a plain dictionary model.
ORACLE_SQL: dict[str, str] = {}
