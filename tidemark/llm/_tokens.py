"""Token ids of whole texts, with each distinct unit of a task encoded once.

Byte-level BPE first splits a text by a pattern.  A run of other characters
with at most one blank before it (a unit) is split the same wherever it stands,
and so is a run of white space that is left over; so the ids of a text are
those of its units, one after the other.  Units are found as byte ranges of
whole batches and looked up by a 64-bit hash in sorted arrays; those that are
new go to the tokenizer.  Texts with white space outside ASCII, where units
don't hold, go to the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from ._words import SPACE, hash_ranges, text_pieces

#: Units and ids that a task remembers at most; it begins anew beyond that.
MOST_UNITS, MOST_IDS = 400_000, 2_500_000
#: Bytes of text that are encoded at once; a single longer text is a piece of its own.
PIECE_BYTES = 1 << 20



def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd(raw: np.ndarray) -> np.ndarray:
    """Where white space outside [\\x20\\x09-\\x0D] begins, or a control character that some patterns take for it."""
    out = (raw >= 0x1C) & (raw <= 0x1F)
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(lead):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        a, b, c = raw[lead], padded[lead + 1], padded[lead + 2]
        hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        hit |= (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))
        hit |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | (b == 0x81))
        hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        out[lead[hit]] = True
    return out


class Encoder:
    """Ids of texts by one tokenizer file; one for each task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.key, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def batches(self, column: pa.Array, end_id: int | None):
        """(first row, ids, where each text's ids begin) of consecutive rows; ``end_id`` follows each text."""
        for first, _, data, offsets in text_pieces(column, PIECE_BYTES):
            ids, of_text = self.piece(data, offsets)
            if end_id is not None:
                ids = np.insert(ids, of_text[1:], end_id)
                of_text = of_text + np.arange(len(of_text))
            yield first, ids, of_text

    def piece(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not data:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        odd = _odd(raw)
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1) if odd.any() else np.zeros(0, np.int64)

        blank = SPACE[raw]
        text_head = np.zeros(len(raw) + 1, bool)
        text_head[offsets] = True
        before = np.concatenate([[False], blank[:-1]]) & ~text_head[:-1]
        word = ~blank & (before | text_head[:-1] | np.concatenate([[True], blank[:-1]]))
        joined = np.zeros(len(raw), bool)  # a blank that belongs to the word after it
        after = np.flatnonzero(word & before)
        joined[after[raw[after - 1] == 0x20] - 1] = True
        head = joined.copy()
        word[1:] &= ~joined[:-1]
        head |= word
        # What is left of a run of white space: all but its last character, which stands alone before a word if it isn't a blank.
        rest = blank & ~joined
        last_of_run = rest & np.concatenate([~blank[1:], [True]]) & ~text_head[1:]
        head |= rest & (text_head[:-1] | np.concatenate([[True], ~blank[:-1]]) | last_of_run)
        start = np.flatnonzero(head)
        end = np.concatenate([start[1:], [len(raw)]])
        ids, count = self.look_up(data, start, end)
        of_unit = np.concatenate([[0], np.cumsum(count)])
        of_text = of_unit[np.searchsorted(start, offsets)]
        if len(whole):
            parts = [ids[of_text[k] : of_text[k + 1]] for k in range(n)]
            for k, got in zip(whole, self.encode([data[offsets[k] : offsets[k + 1]].decode() for k in whole]), strict=True):
                parts[k] = np.array(got, np.int32)
            ids, of_text = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, of_text

    def look_up(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = hash_ranges(data, start, end)
        own, at = np.unique(key, return_inverse=True)
        place = np.searchsorted(self.key, own)
        new = np.ones(len(own), bool)
        known = place < len(self.key)
        new[known] = self.key[place[known]] != own[known]
        if new.any():
            sample = np.zeros(len(own), np.int64)
            sample[at] = np.arange(len(key))
            units = sample[new]
            got = self.encode([data[start[u] : end[u]].decode(errors="replace") for u in units])
            count = np.array([len(x) for x in got], np.int32)
            begin = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]])
            ids = np.concatenate([self.ids, np.array([y for x in got for y in x], np.int32)])
            keys = np.concatenate([self.key, own[new]])
            order = np.argsort(keys, kind="stable")
            self.key, self.begin, self.count, self.ids = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order], ids
            place = np.searchsorted(self.key, own)
        place = place[at]
        count, begin = self.count[place].astype(np.int64), self.begin[place]
        shift = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        out = self.ids[np.arange(count.sum()) + shift]
        if len(self.key) > MOST_UNITS or len(self.ids) > MOST_IDS:
            self.forget()
        return out, count
