"""Hierarchical packing of token streams into context windows of several lengths.

Every document (its ids, then an end id) gives as many whole windows of the
longest tier as it fills.  What is left of it is routed to the shortest tier
that holds it.  Tiers are packed from the longest to the shortest: a remainder
opens a window of its tier and the gap behind it is filled from shorter tiers,
a piece that fits first, else one that is cut.  So every window is full, and
as tiers are powers of two no window is padded.  A task's last window, which
nothing is left to fill, is cut into powers of two.  Windows are dealt to step
groups of one tier and equal numbers of tokens: as tiers divide a step, each
tier of a task leaves one short step at most.

Packing is local to a task: pieces of a few thousand documents wait in memory,
no row is shuffled and ``sequence_id`` is the task's number and a counter.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each for itself; a null id stays null; a text of any length is cut, not
shortened; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import map_batches
from ._tokens import Encoder, vocabulary_path

TIERS = (1024, 512, 256, 128)
#: Remainders that wait for others before a task packs them, and tokens of a step group.
WAITING, STEP_TOKENS = 8192, 16384


class Packer:
    """Packs pieces (document, start, ids) of one task; ``out`` collects (document, start, ids, sequence, offset, tier)."""

    def __init__(self, tiers=TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self.waiting = {t: deque() for t in self.tiers}
        self.count, self.sequences, self.out = 0, 0, []

    def add(self, doc: int, ids: np.ndarray) -> None:
        longest = self.tiers[0]
        whole = len(ids) // longest * longest
        for at in range(0, whole, longest):
            self.put([(doc, at, ids[at : at + longest])], longest)
        if whole < len(ids):
            self.wait((doc, whole, ids[whole:]))

    def wait(self, piece, first: bool = False) -> None:
        tier = min(t for t in self.tiers if t >= len(piece[2]))
        (self.waiting[tier].appendleft if first else self.waiting[tier].append)(piece)
        self.count += 1

    def take(self, tier: int):
        self.count -= 1
        return self.waiting[tier].popleft()

    def put(self, pieces: list, tier: int) -> None:
        at = 0
        for doc, start, ids in pieces:
            self.out.append((doc, start, ids, self.sequences, at, tier))
            at += len(ids)
        self.sequences += 1

    def flush(self) -> None:
        """Pack what waits into whole windows; a window that can't be filled waits on as its pieces."""
        for tier in self.tiers:
            while self.waiting[tier]:
                pieces, gap = [self.take(tier)], tier
                gap -= len(pieces[0][2])
                while gap and self.count:
                    fits = next((t for t in self.tiers if t < tier and self.waiting[t] and len(self.waiting[t][0][2]) <= gap), None)
                    if fits is None:
                        fits = next(t for t in reversed(self.tiers) if self.waiting[t])
                    doc, start, ids = self.take(fits)
                    pieces.append((doc, start, ids[:gap]))
                    if len(ids) > gap:
                        self.wait((doc, start + gap, ids[gap:]), first=True)
                    gap -= len(pieces[-1][2])
                if gap:
                    for piece in pieces:
                        self.wait(piece)
                    return
                self.put(pieces, tier)

    def finish(self) -> None:
        """Pack the rest: it is shorter than a window, so it is cut at powers of two."""
        self.flush()
        rest = [self.take(t) for t in self.tiers for _ in range(len(self.waiting[t]))]
        left = sum(len(ids) for _, _, ids in rest)
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                pieces, gap = [], 1 << bit
                while gap:
                    doc, start, ids = rest.pop(0)
                    pieces.append((doc, start, ids[:gap]))
                    if len(ids) > gap:
                        rest.insert(0, (doc, start + gap, ids[gap:]))
                    gap -= len(pieces[-1][2])
                self.put(pieces, 1 << bit)


class Steps:
    """Deals windows to steps of STEP_TOKENS; windows of each tier wait until they fill a step."""

    def __init__(self, tokens: int = STEP_TOKENS):
        self.tokens, self.open, self.steps = tokens, {}, 0

    def of(self, tier: int) -> int:
        """The step of the next window of a tier; a tier has one open step."""
        step, held = self.open.get(tier, (None, 0))
        if step is None or held + tier > self.tokens:
            step, held, self.steps = self.steps, 0, self.steps + 1
        self.open[tier] = (step, held + tier) if held + tier < self.tokens else (None, 0)
        return step


def _pack(batches, vocabulary: str, tiers: tuple[int, ...], end_id: int, step_tokens: int):
    encoder, packer, steps = Encoder(vocabulary), Packer(tiers), Steps(step_tokens)
    task = TaskContext.get().partitionId() << 33
    step_of: dict[int, int] = {}
    waiting: dict[int, tuple[object, int, int]] = {}  # document's number: its id, tokens, tokens not yet given out
    number, kind = 0, None

    def rows():
        out, packer.out = packer.out, []
        ids_of, tokens = [], []
        for doc, _, ids, seq, _, tier in out:
            if seq not in step_of:
                step_of[seq] = steps.of(tier)
            key, total, left = waiting[doc]
            ids_of.append(key)
            tokens.append(total)
            if left == len(ids):
                del waiting[doc]
            else:
                waiting[doc] = (key, total, left - len(ids))
        columns = [
            pa.array(ids_of, kind), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].astype("<u4").tobytes() for x in out], pa.binary()), pa.array(tokens, pa.int64()),
            pa.array([task + x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64()), pa.array([x[5] for x in out], pa.int32()), pa.array([task + step_of[x[3]] for x in out], pa.int64()),
        ]
        step_of.clear()
        return pa.RecordBatch.from_arrays(columns, ["id", "start", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id"])

    for batch in batches:
        kind, keys = batch.column(0).type, batch.column(0).to_pylist()
        for first, ids, of_text in encoder.batches(batch.column(1), end_id):
            for k in range(len(of_text) - 1):
                own = ids[of_text[k] : of_text[k + 1]]
                waiting[number] = (keys[first + k], len(own), len(own))
                packer.add(number, own)
                number += 1
            if packer.count > WAITING:
                packer.flush()
            else:  # what waits may not hold on to whole batches
                for queue in packer.waiting.values():
                    queue.extend([(d, s, x.copy() if x.base is not None else x) for d, s, x in [queue.popleft() for _ in range(len(queue))]])
            yield rows()
    packer.finish()
    if packer.out:
        yield rows()


def pack(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: (id, start, ids, doc_tokens, sequence_id, offset, tier, step_id).

    ``ids`` are little-endian unsigned 32-bit token ids; ``tier`` is the length
    of the sequence that holds the piece.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_id bigint"
    call = partial(_pack, vocabulary=vocabulary or vocabulary_path(), tiers=tuple(tiers), end_id=end_id, step_tokens=step_tokens)
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), call, schema).withColumnRenamed("id", id_col)


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pieces.select(id_col, "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op8_packing": op8_packing}
#: Token ids are not SQL's; tests hold the pieces against the tokenizer's ids.
ORACLE_SQL: dict[str, str] = {}
