"""Harmonic packing of documents into fixed-size sequences.

Piece lengths come from reciprocal-capacity classes: class ``k`` holds pieces of
exactly ``capacity // k`` tokens and a sequence of the class holds exactly ``k``
of them.  Only classes whose full sequence wastes at most ``max_waste`` tokens
are used (class ``capacity``, single tokens, always is), so every full sequence
is nearly full.  A document is cut into whole sequences and the fewest class
pieces that make up its rest (larger pieces first).

Every task fills the sequences of its own documents, class by class, without
shuffle or coordination.  What is left in open sequences at its end is laid end
to end and cut into whole sequences and then powers of two, which need no
padding.  A task holds one open sequence per class, whatever its input.

Edge cases: a null or empty text is its end id alone; repeated rows are packed
each; a null id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ship
from terrascope.llm.encode import encoder
from terrascope.llm.textvec import text_slices

_PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")
_TASK_SHIFT = 40  # sequences of one task


@lru_cache(maxsize=8)
def classes(capacity: int, max_waste: int) -> dict[int, int]:
    """Piece length -> pieces in a full sequence."""
    out = {}
    for k in range(1, capacity + 1):
        size = capacity // k
        if size not in out and capacity - size * (capacity // size) <= max_waste:
            out[size] = capacity // size
    return out


@lru_cache(maxsize=8)
def decompositions(capacity: int, max_waste: int) -> list[tuple[int, ...]]:
    """For every rest below ``capacity``: the fewest class pieces adding up to
    it, longest first (ties prefer longer pieces)."""
    sizes = sorted(classes(capacity, max_waste), reverse=True)
    best: list[tuple[int, ...]] = [()]
    for r in range(1, capacity):
        best.append(min(((s, *best[r - s]) for s in sizes if s <= r), key=len))
    return [tuple(sorted(b, reverse=True)) for b in best]


def _binary(n: int, capacity: int) -> list[int]:
    """``n`` as whole sequences, then falling powers of two."""
    out = [capacity] * (n // capacity)
    n %= capacity
    return out + [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


class _Packer:
    """Open sequences of one task; ``rows`` are finished pieces."""

    def __init__(self, capacity: int, max_waste: int, first_id: int):
        self.capacity, self.slots = capacity, classes(capacity, max_waste)
        self.rest = decompositions(capacity, max_waste)
        self.open: dict[int, list] = {s: [] for s in self.slots}
        self.next, self.rows = first_id, []

    def _close(self, pieces: list) -> None:
        """``pieces``: (doc_id, start, ids, doc_tokens) that share a sequence."""
        length, offset = sum(len(p[2]) for p in pieces), 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset, length))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        """Cut one document and file its pieces."""
        n, at, c = len(ids), 0, self.capacity
        while n - at >= c:
            self._close([(doc_id, at, ids[at:at + c], n)])
            at += c
        for size in self.rest[n - at]:
            pieces = self.open[size]
            pieces.append((doc_id, at, ids[at:at + size], n))
            at += size
            if len(pieces) == self.slots[size]:
                self._close(pieces)
                self.open[size] = []

    def finish(self) -> None:
        """Lay the open sequences end to end and cut them without padding."""
        left = [p for size in self.open for p in self.open[size]]
        left.reverse()
        for room in _binary(sum(len(p[2]) for p in left), self.capacity):
            pieces = []
            while room:
                doc_id, start, ids, total = left.pop()
                pieces.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    left.append((doc_id, start + room, ids[room:], total))
                room -= len(pieces[-1][2])
            self._close(pieces)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, max_waste: int = 4,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id`` and the
    ``offset`` in it; ``sequence_length`` tokens of a sequence are used.  A
    sequence is full but for ``max_waste`` tokens, or a power of two."""
    ship(docs.sparkSession)
    names = [c.split()[0] for c in _PIECE.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        enc = encoder(tokenizer)
        packer = _Packer(capacity, max_waste, TaskContext.get().partitionId() << _TASK_SHIFT)

        def flush():
            columns = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offs in text_slices(batch.column(1)):
                flat, bound = enc.encode_slice(data, offs)
                flat = np.insert(flat, bound[1:], end_id).astype("<u4")
                bound = bound + np.arange(len(bound))
                for d in range(b - a):
                    # a copy: an open piece must not keep the slice alive
                    packer.add(ids[a + d], flat[bound[d]:bound[d + 1]].copy())
                if packer.rows:
                    yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text")).mapInArrow(run, _PIECE)
