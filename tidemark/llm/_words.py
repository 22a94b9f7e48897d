"""Vectorised splitting and hashing of words over whole Arrow batches.

Every operator that works on words shares one definition: A-Z become a-z, a
word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` and a null text is
an empty text.  A batch of UTF-8 texts is handled as one byte buffer, so there
is no Python object per word; a word is a 64-bit hash of its bytes and length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of text that are worked on at once; a single longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES):
    """Yield (first row, end row, bytes, offsets) of consecutive rows of a string column.

    Offsets count from the start of the yielded bytes; nulls have length 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = memoryview(data) if data is not None else memoryview(b"")
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + piece_bytes, side="right")) - 1)
        yield row, end, bytes(raw[at[row] : at[end]]), at[row : end + 1] - at[row]
        row = end


@dataclass
class Words:
    """The words of several texts: byte range and hash of each, and the range of words of each text."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of_text: np.ndarray  # text k has the words of_text[k]:of_text[k + 1]

    @property
    def text_id(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of_text) - 1), np.diff(self.of_text))


def hash_ranges(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; eight bytes are taken at a time."""
    padded = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), shape=(len(padded) - 7, 8), strides=(1, 1))
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * _M3 + _M3)
    live, done = np.arange(len(start)), 0
    while len(live):
        left = size[live] - done
        live, left = live[left > 0], left[left > 0]
        if not len(live):
            break
        block = eight[start[live] + done].view(np.uint64).ravel() & _KEEP[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ block) * _M3 + _M1)
        done += 8
    return out


def split_words(data: bytes, offsets: np.ndarray, lower: bool = True) -> Words:
    if lower:
        data = data.translate(LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, hash_ranges(data, start, end), np.searchsorted(start, offsets))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words and the range of them in each text.

    A text with fewer words has its whole sequence as its one shingle, and none
    if it has no word.
    """
    h, count = words.hash, np.diff(words.of_text)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    of_text = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(of_text[-1]) + np.repeat(words.of_text[:-1] - of_text[:-1], runs)
    width = np.repeat(np.minimum(count, n), runs)
    out = mix(width.astype(np.uint64) + _M2)
    for k in range(n):
        use = k < width
        if use.all():
            out = mix((out ^ h[at + k]) * _M3 + _M2)
        else:
            out[use] = mix((out[use] ^ h[at[use] + k]) * _M3 + _M2)
    return out, of_text
