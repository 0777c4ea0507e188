"""Operator 4, best-fit packing: documents into sequences of a fixed number of tokens.

Bounded-space online best fit. Each task packs its own rows as they come into a fixed number of open sequences. The open ones are kept by free space,
and a bitset marks which free spaces occur; the lowest set bit at or above a piece's length is the tightest sequence that takes it. Where none does
and all are open, the fullest closes. There is no shuffle and no state beyond the open sequences, so a lost task is simply run again and makes the
same sequences: their numbers hold the task's number, which the input's splits fix.

Defined results: a null or empty text is one piece of the end id alone; a null doc_id stays null; repeated rows are packed once each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from siltgrain.llm.word_tokens import in_slices, worker_tokenizer

SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
#: With the pieces' ids.
SCHEMA_IDS = SCHEMA + ", ids binary"


class OpenSequences:
    """Bounded-space best fit: put() says where a piece of a given length goes."""

    def __init__(self, capacity: int, most_open: int, first_id: int = 0):
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = 0

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset there) of a piece of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.n_open == self.most_open:  # the lowest bit: the least free space
                self._take((self.bits & -self.bits).bit_length() - 1)
            sequence, free, self.next_id = self.next_id, self.capacity, self.next_id + 1
        if left := free - length:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.n_open += 1
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.n_open -= 1
        return sequence


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, most_open: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document of docs (doc_id, text): where it lies. with_ids: also its ids, little-endian unsigned 32-bit.

    A document's ids are those of ``tokenizer`` and then end_id. Only documents longer than capacity are cut, into pieces of capacity tokens and a last one of the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_tokenizer(tokenizer)
        packed = OpenSequences(capacity, most_open, TaskContext.get().partitionId() << 40)
        for doc_ids, texts in in_slices(batches):
            ids, offsets = words.encode(texts, end_id)
            raw = memoryview(ids.astype("<u4")).cast("B")
            sizes = np.diff(offsets)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(texts)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = (offsets[row] + start) * 4
            parts = [raw[a : a + 4 * k] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            places = [packed.put(k) for k in length.tolist()]
            columns = [
                doc_ids.take(pa.array(row)).cast(pa.int64()),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                pa.array([x for x, _ in places], pa.int64()),
                pa.array([x for _, x in places], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([bytes(x) for x in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA_IDS if with_ids else SCHEMA)
