"""Documents as pieces in training sequences of a fixed length: bounded-space online best fit."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from starboard.llm.common import ship_code
from starboard.llm.word_bpe import word_bpe

TOKENS = 2048
OPEN_BINS = 4096
LOOK_AHEAD = 8192
LOOK_AHEAD_BYTES = 64 << 20


class OpenBins:
    """At most ``most`` open bins of one capacity, found by their free space.

    Bit f of ``bits`` is set while a bin with f free places is open, so the bin that a piece fills best is the
    lowest set bit from the piece's length on. When one bin too many would be open, the fullest is closed.
    """

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.bits, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return taken

    def place(self, length: int, new_id: int | None = None) -> tuple[int, int]:
        """The bin for a piece of 1 to ``capacity`` places, and where in it the piece starts.

        A bin opened for it gets the number ``new_id``, or else the next one.
        """
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, found = self.capacity, self.next_id if new_id is None else new_id
            self.next_id = found + 1
        if left := free - length:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    carry: Sequence[str] = ("doc_id",),
    text: str = "text",
    tokens: int = TOKENS,
    end_id: int = 0,
    open_bins: int = OPEN_BINS,
    look_ahead: int = LOOK_AHEAD,
    position: str | None = None,
) -> DataFrame:
    """One row for each piece: ``carry``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``, ``offset``.

    Each task reads its documents in order, turns them into ids with ``end_id`` after each, and packs them; there
    is no shuffle, and no state beyond the open bins and the look-ahead. Only documents longer than ``tokens``
    are cut, into pieces of that length and a rest. Of up to ``look_ahead`` pieces that have arrived (or 64 MB of
    ids) the longest are placed first, ties in order of arrival. ``ids`` are little-endian unsigned 32-bit
    values; ``offset`` is the piece's first place in its sequence. Sequence numbers are unique, not dense, and follow
    the order of the rows: a sequence stands where its first piece (``offset`` 0) arrived, whatever its length, and
    the other pieces in it come from the same ``look_ahead`` or fill a bin that was still open. ``position`` names a
    column with the row's number in an order that goes over all partitions: sequence numbers follow it, and where a
    task's rows leave it, all bins are closed. A null or empty text is ``end_id`` alone; no documents give no rows.
    Other columns are not read.
    """
    ship_code(docs.sparkSession)
    picked = docs.select(*carry, text, *([position] if position else []))
    schema = T.StructType(
        [f for f in picked.schema if f.name in carry]
        + [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    n = len(carry)
    # A text has less than 2 ** 31 bytes, and not more pieces than this many bits can number.
    piece_bits = 32 - (tokens.bit_length() - 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 33)
        bins = OpenBins(tokens, open_bins, 0)
        tokenizer, width = word_bpe(tokenizer_path), 4 * tokens
        end = end_id.to_bytes(4, "little")
        waiting: list[tuple] = []
        held, arrow, follows = 0, None, None

        def flush() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(waiting)), key=lambda i: -len(waiting[i][-2]))
            rows: list[tuple] = [()] * len(waiting)
            for i in order:
                *known, at, ids, number = waiting[i]
                length = len(ids) // 4
                sequence, offset = bins.place(length, number)
                rows[i] = (*known, at, length, ids, sequence, offset)
            for first in range(0, len(rows), 2048):
                columns = zip(*rows[first : first + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

        for batch in batches:
            if arrow is None:
                fields = [batch.schema.field(i) for i in range(n)]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                arrow = pa.schema(fields + [pa.field(f.name, k) for f, k in zip(schema.fields[n:], kinds)])
            known = list(zip(*(batch.column(i).to_pylist() for i in range(n)))) or [()] * batch.num_rows
            places = batch.column(n + 1).to_pylist() if position else itertools.repeat(None)
            for row, value, place in zip(known, batch.column(n), places):
                if place != follows:
                    yield from flush()
                    waiting, held, bins = [], 0, OpenBins(tokens, open_bins, 0)
                if position:
                    numbers, follows = itertools.count(place << piece_bits), place + 1
                ids = tokenizer.ids(value.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    waiting.append((*row, piece, at // 4, ids[at : at + width], next(numbers)))
                held += len(ids)
                if len(waiting) >= look_ahead or held >= LOOK_AHEAD_BYTES:
                    yield from flush()
                    waiting, held = [], 0
        if waiting:
            yield from flush()

    return picked.mapInArrow(packed, schema)
