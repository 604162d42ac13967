"""Best-fit packing of tokenised documents into sequences.

Bounded-space online best-fit: each task keeps at most ``open_bins`` open
sequences, filed by their free space, and an integer whose bit f is set while
some open sequence has f free places. A piece goes where it leaves the least
free space, which is the lowest set bit at or above its length. If nothing fits
and all places are taken, the fullest sequence closes first.

Each task packs the documents of its own input split, so nothing is shuffled and
what a task holds doesn't grow with the table. A task leaves at most
``open_bins`` sequences that are not full.

Defined results: a null or empty text is one piece with the end id alone; an
empty table gives no rows; rows that repeat each other are packed each; a null
doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, text_or_empty
from .encode import Encoder


class BestFit:
    """place(length) gives (sequence, offset)."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0) -> None:
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        self.n_open -= 1
        if not bins:
            self.bits ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self.take(free)
        else:
            if self.n_open == self.open_bins:
                self.take((self.bits & -self.bits).bit_length() - 1)
            free, sequence = self.capacity, self.next
            self.next += 1
        if left := free - length:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.n_open += 1
        return sequence, self.capacity - free


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = 2048, open_bins: int = 256) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer), struct.pack("<I", end_id)
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            rows = batch.column("doc_id")
            for at, ids, ends in encoder.slices(batch.column("text")):
                flat, took, out, first = ids.tobytes(), [], [], 0
                for row, last in enumerate((4 * ends).tolist(), at):
                    for piece, start in enumerate(range(first, last + 1, 4 * capacity)):
                        part = flat[start : min(start + 4 * capacity, last)]
                        if len(part) < 4 * capacity:
                            part += end  # the end id comes after the last id, in a piece of its own if need be
                        out.append((piece, piece * capacity, len(part) // 4, zlib.crc32(part), *bins.place(len(part) // 4)))
                        took.append(row)
                    first = last
                columns = list(zip(*out, strict=True)) or [[]] * 6
                kinds = [pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(took, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(giving_back(run), schema)
