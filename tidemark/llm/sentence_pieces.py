"""SentencePiece encoding and decoding for vocabularies of merges, by a score-ordered agenda of adjacent symbol pairs.

A text begins as its characters, with ``▁`` before it and for every blank.  The
agenda holds the pairs of adjacent symbols that together are a piece, the best
score first and the leftmost of equal ones; the first pair is merged and the
pairs beside it take its place until the agenda is empty.  What is no piece
then is given as the pieces of its bytes.

A merge makes a piece.  So where no piece has two bytes beside each other, as
the end of a character and the begin of the next, no merge goes across, and a
text falls apart into units there, mostly a blank and a word; the ids of a text
are those of its units.  Each distinct unit of a worker (told apart by its
bytes) is encoded once.  Agendas of all new units of a batch advance together as
arrays, a merge for each unit a step; a unit of over ``LONG`` symbols has an
agenda of its own, a heap.

Every new unit of a batch is checked in the same task: the sentencepiece
library encodes and decodes them as one text, with a character between them
that never merges.  Another result is an error, never a silent difference.

Defined cases: a null or empty text is the begin and the end id alone, and
decodes to an empty text; a literal ``▁`` is a blank, as in the library;
repeated rows are encoded each for itself; a null id stays null; texts of any
length are encoded whole; further columns are not read; an empty table gives no
rows.  A vocabulary of another kind (own normalisation, no bytes, every white
space character in longer pieces) is refused.
"""

from __future__ import annotations

import codecs
import heapq
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import map_batches
from ._tokens import vocabulary_path
from ._words import text_pieces

#: Symbols of a unit from which on it has a heap of its own.
LONG = 48
#: Units and ids that a worker remembers at most; it begins anew beyond that.
MOST_UNITS, MOST_IDS = 400_000, 2_500_000
#: Bytes of text that are encoded at once; a single longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: What a blank is in pieces.
BLANK = "▁"
NONE = np.iinfo(np.int64).max
_BITS = np.int64(21)  # a symbol is a piece's id or, beyond them, a code point


class Vocabulary:
    """A model's pieces as arrays: symbols of characters, pairs that merge, bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(k) for k in range(n)]
        reserved = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) for k in range(n)]
        ids = {p: k for k, p in enumerate(pieces) if not reserved[k]}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        probes = ("", " ", " a  b ", "éÅﬁ\t\n", "Ａ ▁x")
        as_is = all(sp.normalize(t) == (BLANK + t if t else "").replace(" ", BLANK) for t in probes)
        if not as_is or not all(sp.is_byte(int(k)) for k in self.byte_ids) or any(map(sp.is_unused, range(n))):
            raise ValueError(f"{path}: not a vocabulary of merges with bytes and plain normalisation")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        held = {c for p in ids if len(p) > 1 for c in p}
        self.alone = [c for c in "\n\t\r" if c not in held]  # these never merge
        if not self.alone:
            raise ValueError(f"{path}: every white space character is part of longer pieces")

        self.joins = np.zeros((256, 256), bool)  # bytes that are beside each other in a piece
        for p in ids:
            raw = np.frombuffer(p.replace(BLANK, " ").encode(), np.uint8)
            self.joins[raw[:-1], raw[1:]] = True

        self.of_char = np.arange(0x110000, dtype=np.int64) + n
        for p, k in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        self.of_char[ord(" ")] = self.of_char[ord(BLANK)]
        order = {s: r for r, s in enumerate(sorted({sp.get_score(k) for k in ids.values()}, reverse=True))}
        symbol = lambda p: ids.get(p, int(self.of_char[ord(p)]) if len(p) == 1 else None)
        found = [(left << 21 | right, order[sp.get_score(k)], k) for p, k in ids.items() for at in range(1, len(p)) if (left := symbol(p[:at])) is not None and (right := symbol(p[at:])) is not None]
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
        self.pair, self.rank, self.merged = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()

        given = [b"" if sp.is_control(k) else bytes([int(p[1:-1], 16)]) if sp.is_byte(k) else " ⁇ ".encode() if sp.is_unknown(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(given), np.uint8)
        self.length = np.array([len(x) for x in given], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.spaced = np.array([x[:1] == b" " and not held for x, held in zip(given, reserved, strict=True)])

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; rank is NONE where they are no piece together."""
        key = left << _BITS | right
        place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[place] == key
        return np.where(hit, self.rank[place], NONE), self.merged[place]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def by_heap(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The symbols of one unit after all merges, by a heap of (rank, place of the left symbol)."""
    n, table = len(symbols), v.table
    after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap: list[tuple[int, int, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        found = table.get(symbols[a] << 21 | symbols[b])
        if found:
            heapq.heappush(heap, (found[0], a, b, version[a], version[b], found[1]))

    for k in range(n - 1):
        offer(k, k + 1)
    while heap:
        _, a, b, va, vb, merged = heapq.heappop(heap)
        if version[a] != va or version[b] != vb:  # one of them has been merged since
            continue
        symbols[a], version[a], version[b] = merged, version[a] + 1, -1
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
            offer(a, after[a])
        if before[a] >= 0:
            offer(before[a], a)
    return [s for s, k in zip(symbols, version, strict=True) if k >= 0]


def by_arrays(v: Vocabulary, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, count of each unit) after all merges of many short units, which follow one another in ``symbols``."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    unit = np.arange(len(count))
    inside = np.ones(len(symbols), bool)  # whether a symbol is followed by one of its unit
    inside[np.cumsum(count) - 1] = False
    rank, merged = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
    at = np.flatnonzero(inside)
    rank[at], merged[at] = v.pairs(symbols[at], symbols[at + 1])
    while len(unit):
        begin = np.cumsum(count) - count
        least = np.minimum.reduceat(rank, begin)
        over = least == NONE
        if over.any():
            gone = np.repeat(over, count)
            done.append((unit[over], count[over], symbols[gone]))
            unit, count, least = unit[~over], count[~over], least[~over]
            symbols, rank, merged = symbols[~gone], rank[~gone], merged[~gone]
            if not len(unit):
                break
            begin = np.cumsum(count) - count
        best = np.flatnonzero(rank == np.repeat(least, count))
        owner = np.searchsorted(begin, best, side="right") - 1
        first = np.ones(len(best), bool)
        first[1:] = owner[1:] != owner[:-1]
        a = best[first]  # in each unit the leftmost pair of the best rank
        symbols[a] = merged[a]
        keep = np.ones(len(symbols), bool)
        keep[a + 1] = False
        rank[a] = rank[a + 1]  # NONE where the right one was the unit's last, else looked up anew below
        symbols, rank, merged = symbols[keep], rank[keep], merged[keep]
        a -= np.arange(len(a))
        count = count - 1
        begin = np.cumsum(count) - count
        for x in (a[a + 1 < begin + count], (a - 1)[a > begin]):
            rank[x], merged[x] = v.pairs(symbols[x], symbols[x + 1])
    if not done:
        return symbols, count
    unit, count = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    symbols = np.concatenate([d[2] for d in done])
    order = np.argsort(unit, kind="stable")
    begin = (np.cumsum(count) - count)[order]
    count = count[order]
    return symbols[_spread(begin, count)], count


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin[0], begin[0] + 1, ... count[0] of them, then those of begin[1], and so on."""
    return np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)


class Encoder:
    """Ids of texts; it remembers the units that it has met."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def batches(self, column: pa.Array):
        """(ids, where each text's ids begin) of consecutive rows, with begin and end ids."""
        v, column = self.v, column.fill_null("")
        if pc.any(pc.match_substring(column, BLANK)).as_py():
            column = pc.replace_substring(column, BLANK, " ")
        for _, _, data, offsets in text_pieces(column, PIECE_BYTES):
            ids, of_text = self.piece(data, offsets)
            ends = np.insert(np.insert(ids, of_text[1:], v.end), of_text[:-1] + np.arange(len(of_text) - 1), v.begin)
            yield ends, of_text + 2 * np.arange(len(of_text))

    def piece(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that follow one another in ``data``, each with a blank put before it unless it is empty."""
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = np.insert(np.frombuffer(data, np.uint8), offsets[some], 0x20)
        head = offsets[some] + np.arange(len(some))
        first = np.ones(len(raw), bool)
        first[1:] = ~self.v.joins[raw[:-1], raw[1:]] & ((raw[1:] & 0xC0) != 0x80)
        first[head] = True
        start = np.flatnonzero(first)
        edge = np.append(start, len(raw))
        units = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        ids, count = self.look_up(units.dictionary.to_pylist())
        begin, unit = np.cumsum(count) - count, units.indices.to_numpy()
        of_unit = np.concatenate([[0], np.cumsum(count[unit])])
        of_text = np.zeros(len(offsets), np.int64)
        of_text[some + 1] = of_unit[np.append(np.searchsorted(start, head[1:]), len(start))]
        return ids[_spread(begin[unit], count[unit])], np.maximum.accumulate(of_text)

    def look_up(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of distinct units, one after the other."""
        new = [u for u in units if u not in self.number]
        if new:
            if len(self.number) + len(new) > MOST_UNITS or len(self.ids) > MOST_IDS:
                self.forget()
                new = units
            ids, count = self.encode(new)
            self.check(new, ids, count)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        at = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        return self.ids[_spread(self.begin[at], self.count[at])], self.count[at]

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of units by agendas."""
        v, text = self.v, b"".join(units)
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        edge = np.concatenate([[0], np.cumsum([len(u) for u in units])])
        chars = np.concatenate([[0], np.cumsum(lead)])[edge]
        symbols, count = v.of_char[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)], np.diff(chars)
        long = count > LONG
        short, n_short = by_arrays(v, symbols[~np.repeat(long, count)], count[~long])
        if long.any():
            merged = [by_heap(v, symbols[chars[k] : chars[k + 1]].tolist()) for k in np.flatnonzero(long)]
            size = np.zeros(len(units), np.int64)
            size[~long], size[long] = n_short, [len(x) for x in merged]
            symbols = np.zeros(size.sum(), np.int64)
            of_long = np.repeat(long, size)
            symbols[~of_long], symbols[of_long] = short, np.concatenate([np.array(x, np.int64) for x in merged])
        else:
            symbols, size = short, n_short
        odd = np.flatnonzero(symbols >= v.size)
        if not len(odd):
            return symbols.astype(np.int32), size
        given = [v.byte_ids[list(chr(int(c) - v.size).encode())] for c in symbols[odd]]
        wide = np.ones(len(symbols), np.int64)
        wide[odd] = [len(x) for x in given]
        out = np.repeat(symbols, wide)
        out[np.repeat(symbols >= v.size, wide)] = np.concatenate(given)
        total = np.concatenate([[0], np.cumsum(wide)])
        last = np.cumsum(size)
        return out.astype(np.int32), total[last] - total[last - size]

    def check(self, units: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        """Hold the ids of new units against the library's, as one text with a lone character before each unit."""
        v, lone = self.v, self.v.alone[0]
        text = lone + lone.join(u.decode() for u in units)
        theirs = np.array(v.library.encode(text, num_threads=1), np.int32)
        mark = v.of_char[ord(lone)] if v.of_char[ord(lone)] < v.size else v.byte_ids[ord(lone)]
        own = np.concatenate([[v.of_char[ord(BLANK)]], np.insert(ids, np.cumsum(count) - count, mark)])
        if not np.array_equal(own, theirs):
            raise ValueError("the agenda's ids differ from the sentencepiece library's")
        if decode(v, theirs, np.array([0, len(theirs)]))[0].as_py() != v.library.decode(theirs.tolist()):
            raise ValueError("the decoded text differs from the sentencepiece library's")


def _one_for_each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("tidemark_bytes", _one_for_each_byte)


def decode(v: Vocabulary, ids: np.ndarray, of_text: np.ndarray) -> pa.Array:
    """The texts of ids: control ids give nothing, the blank before a text goes, each byte of no character is U+FFFD."""
    length = v.length[ids]
    total = np.concatenate([[0], np.cumsum(length)])
    raw = v.raw[_spread(v.at[ids], length)]
    # the first id of each text that gives anything, where it begins with a blank
    said = np.flatnonzero(length)
    place = np.searchsorted(said, of_text[:-1])
    there = place < len(said)
    first = said[place[there]]
    first = first[(first < of_text[1:][there]) & v.spaced[ids[first]]]
    drop = total[first]
    edge = total[of_text]
    edge = edge - np.searchsorted(drop, edge)
    raw = np.delete(raw, drop)
    found = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(raw)])
    try:
        raw.tobytes().decode()
        return found.cast(pa.string())
    except (UnicodeDecodeError, pa.ArrowInvalid):
        return pa.array([x.decode(errors="tidemark_bytes") for x in found.to_pylist()], pa.string())


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of this worker; later tasks in it find the units of earlier ones."""
    return Encoder(path)


def _encode(batches, path: str):
    encoder = encoder_of(path)
    for batch in batches:
        key, row = batch.column(0), 0
        for ids, of_text in encoder.batches(batch.column(1)):
            n = len(of_text) - 1
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((of_text * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([key.slice(row, n), raw, decode(encoder.v, ids, of_text)], ["id", "ids", "decoded"])
            row += n


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): each row's ids with begin and end id, as little-endian unsigned 32-bit integers, and the text that they decode to."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, partial(_encode, path=path or vocabulary_path("piece_bpe_32k.model")), f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op12_sentence_pieces": op12_sentence_pieces}
#: Ids of a vocabulary are not SQL's; tests hold them against the library over whole texts.
ORACLE_SQL: dict[str, str] = {}
