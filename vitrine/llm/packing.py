"""Operator 4: packing token sequences by minimum bin slack.

Each document's ids are cut into full windows and one remainder.  Every task packs the remainders of its own partition,
a bounded batch at a time: for the longest one left, a subset-sum dynamic programme over the counts of the other
lengths, held in one bitset, finds the multiset that fills the rest of the window closest to its capacity; stepping back
through the bitsets gives how many pieces of each length it takes, and the same multiset is used as often as the counts
allow.  Windows without slack are given out, pieces without an exact partner wait for the next batch, a bounded number of
them; beyond it, and when the task ends, the longest are laid end to end and cut into windows, the very last into powers
of two, which need no padding.  No
ids are shuffled, and no task sees more than its partition.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import chunks
from vitrine.llm.common import whole_text

#: Remainders that a task gathers before it packs them, and those without a partner that it lets wait.
BATCH_PIECES, MOST_WAITING = 4096, 12288


def closest_fill(counts: Counter, room: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths from ``counts`` whose sum is closest to ``room`` from below, and the slack it leaves.

    Lengths go into the bitset from the longest to the shortest; bit s says that some multiset sums to s.  The search
    ends as soon as the bit of ``room`` is set.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        before, left, block = reach, min(counts[length], room // length), 1
        most = left
        while left:
            take = min(block, left)
            reach |= reach << take * length
            left -= take
            block *= 2
        reach &= mask
        steps.append((length, most, before))
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    slack, chosen = room - total, {}
    for length, most, before in reversed(steps):
        taken = next(k for k in range(most + 1) if total >= k * length and before >> total - k * length & 1)
        if taken:
            chosen[length] = taken
            total -= taken * length
    return chosen, slack


def exact_windows(counts: Counter, capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Window contents without slack and how often each is used; takes them out of ``counts``.  What stays in
    ``counts`` can't fill a window exactly together with its longest piece."""
    aside = Counter()
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen, slack = closest_fill(counts, capacity - seed)
        counts[seed] += 1
        if slack:
            aside[seed] += counts.pop(seed)
            continue
        window = Counter(chosen)
        window[seed] += 1
        times = min(counts[x] // k for x, k in window.items())
        for x, k in window.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        yield dict(window), times
    counts.update(aside)


class _Packer:
    """One task's windows.  Rows: (document row, start, length, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.held = self.fresh = 0
        self.rows: list[tuple] = []

    def _put(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc, ids: bytes) -> None:
        total, size = len(ids) // 4, 4 * self.capacity
        for at in range(0, len(ids), size):
            piece = (doc, at // 4, ids[at : at + size], total)
            if len(piece[2]) == size:
                self._put([piece])
            else:
                self.waiting[len(piece[2]) // 4].append(piece)
                self.held += 1
                self.fresh += 1

    def fill(self) -> None:
        """Pack the waiting remainders into windows without slack; of those without a partner the longest are cut where
        too many wait."""
        counts = Counter({length: len(x) for length, x in self.waiting.items() if x})
        for window, times in exact_windows(counts, self.capacity):
            for _ in range(times):
                self._put([self.waiting[x].pop() for x, k in sorted(window.items(), reverse=True) for _ in range(k)])
        self._settle()
        if self.held > MOST_WAITING:
            self._cut(self.held - BATCH_PIECES, False)

    def _settle(self) -> None:
        self.waiting = defaultdict(list, {x: p for x, p in self.waiting.items() if p})
        self.held = sum(map(len, self.waiting.values()))
        self.fresh = 0

    def _cut(self, pieces: int, last: bool) -> None:
        """Lay the ``pieces`` longest remainders end to end and cut them into full windows; what is over waits on, or, if
        these are the last, is cut into powers of two."""
        left = []
        for x in sorted(self.waiting, reverse=True):
            while self.waiting[x] and len(left) < pieces:
                left.append(self.waiting[x].pop())
        left.reverse()
        rest = sum(len(p[2]) for p in left) // 4
        while rest >= self.capacity or last and rest:
            size = self.capacity if rest >= self.capacity else 1 << rest.bit_length() - 1
            window, room = [], size
            while room:
                doc, start, ids, total = left.pop()
                n = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    left.append((doc, start + n, ids[4 * n :], total))
                room -= n
            self._put(window)
            rest -= size
        for piece in left:
            self.waiting[len(piece[2]) // 4].append(piece)
        self._settle()

    def close(self) -> None:
        """Pack what is left."""
        self.fill()
        self._cut(self.held, True)


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode whole texts and pack them into windows of ``capacity`` ids.

    Returns one row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are little-endian
    unsigned 32-bit integers, ``start`` counts the document's ids before the piece, and each document's ids end with
    ``end_id``.  A sequence is full, or a power of two long.  A null or empty text is one piece with the end id alone;
    repeated rows are packed like any other; a null id stays null; an empty table gives no rows; other columns are not
    carried.  Sequence numbers are unique, not gapless.
    """
    kept = docs.select(F.col(id_col), whole_text(text_col).alias("__text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    id_type = dict(kept.dtypes)[id_col]
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunks.library_encoder(path)
        packer = _Packer(capacity, TaskContext.get().partitionId() << 32)
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                columns = list(zip(*packer.rows))
                kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
                packer.rows.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks.pieces(texts):
                for key, ids in zip(keys[a:b], encoder.encode(texts[a:b])):
                    packer.add(key, ids + end)
                if packer.fresh >= BATCH_PIECES:
                    packer.fill()
                if len(packer.rows) >= 2000:
                    yield from flush()
        packer.close()
        yield from flush()

    schema = f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return kept.mapInArrow(run, schema)
