"""Harmonic packing of documents into fixed-size token sequences.

Lengths are partitioned into reciprocal-capacity classes: class k holds the
lengths in (C/(k+1), C/k] of a capacity C, and its bins take exactly k whole
documents.  What a bin of k documents leaves free is filled by the next
document to arrive, which is cut there; its rest is classed by its own length.
Lengths over C give whole sequences first; those under C/64 form the last
class, laid one after the other and cut where a sequence is full.  So a
sequence costs at most one cut, and no bin is padded.

Every task fills the bins of its own rows, so nothing is shuffled and a
repeated task gives whole sequences again.  A task holds at most k - 1
documents of class k, under C tokens for each class.  At its end the documents
of unfinished bins are laid out like the last class, and the last sequence is
cut into powers of two, which need no padding.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import text_blocks
from .common import on_workers, text_or_empty
from .word_ids import WordIds, default_vocabulary

CAPACITY, SMALLEST, END_ID = 4096, 64, 2

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, sequence_tokens long")


class Packer:
    """Bins of one task.  ``rows`` collects finished pieces."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, smallest: int = SMALLEST):
        self.capacity, self.smallest = capacity, smallest
        self.next = first_sequence
        self.bins: dict[int, list] = {}     # class k: fewer than k documents
        self.open: list = []                # a bin of k documents that has room left
        self.room = 0
        self.tail: list = []
        self.tail_size = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset, total = 0, sum(p[2] for p in pieces)
        for doc, start, length, ids, n in pieces:
            self.rows.append((doc, start, length, ids, n, self.next, offset, total))
            offset += length
        self.next += 1

    def _lay(self, piece: tuple) -> None:
        """Append to the running sequence, cutting where it is full."""
        doc, start, length, ids, n = piece
        while length:
            take = min(length, self.capacity - self.tail_size)
            self.tail.append((doc, start, take, ids[:4 * take], n))
            self.tail_size += take
            start, length, ids = start + take, length - take, ids[4 * take:]
            if self.tail_size == self.capacity:
                self._close(self.tail)
                self.tail, self.tail_size = [], 0

    def _fill(self, doc, start: int, ids: bytes, n: int) -> int:
        """Put tokens from ``start`` into the bin that has room; where it ends."""
        take = min(self.room, n - start)
        if take:
            self.open.append((doc, start, take, ids[4 * start:4 * (start + take)], n))
            self.room -= take
            if not self.room:
                self._close(self.open)
                self.open = []
        return start + take

    def add(self, doc, ids: bytes) -> None:
        """Place a document (little-endian uint32 ids)."""
        n = len(ids) // 4
        start = self._fill(doc, 0, ids, n)
        while n - start >= self.capacity:
            self._close([(doc, start, self.capacity, ids[4 * start:4 * (start + self.capacity)], n)])
            start += self.capacity
        size = n - start
        if not size:
            return
        piece = (doc, start, size, ids[4 * start:], n)
        if size < self.smallest:
            self._lay(piece)
            return
        k = self.capacity // size
        bin_ = self.bins.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self.bins[k] = []
            self.open, self.room = bin_, self.capacity - sum(p[2] for p in bin_)
            if not self.room:
                self._close(self.open)
                self.open = []

    def finish(self) -> None:
        for bin_ in [self.open] + [self.bins[k] for k in sorted(self.bins)]:
            for piece in bin_:
                self._lay(piece)
        self.bins, self.open, self.room = {}, [], 0
        rest, left = self.tail, self.tail_size
        self.tail, self.tail_size = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            pieces, room = [], size
            while room:
                doc, start, length, ids, n = rest[0]
                take = min(length, room)
                pieces.append((doc, start, take, ids[:4 * take], n))
                rest[0:1] = [(doc, start + take, length - take, ids[4 * take:], n)] if take < length else []
                room -= take
            self._close(pieces)
            left -= size


def _pack(vocabulary: str, end_id: int, capacity: int, smallest: int, schema: pa.Schema):
    def run(batches):
        encoder = WordIds(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, smallest)
        end = int(end_id).to_bytes(4, "little")

        def flush():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_blocks(texts):
                for doc, tokens in zip(ids[lo:hi], encoder.encode(texts[lo:hi])):
                    packer.add(doc, tokens + end)
                if packer.rows:
                    yield flush()
        packer.finish()
        if packer.rows:
            yield flush()
    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                   end_id: int = END_ID, capacity: int = CAPACITY, smallest: int = SMALLEST) -> DataFrame:
    """One row per piece: ``doc_id, start`` (ids of the document before it),
    ``length, ids`` (little-endian uint32), ``doc_tokens`` (with the end id),
    ``sequence_id, offset`` (in the sequence, gapless from 0) and
    ``sequence_tokens`` (``capacity`` or a power of two).

    * NULL and empty texts consist of the end id.  Every row of ``docs`` is
      packed, also rows that repeat an id or have a NULL id.
    * ``capacity`` must be a power of two; documents of under ``smallest``
      tokens form the last class.
    * Other columns are ignored; an empty table gives an empty result.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("sequence_tokens", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return on_workers(rows).mapInArrow(_pack(vocabulary, end_id, capacity, smallest, schema), SCHEMA)


def packed_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_tokens")
