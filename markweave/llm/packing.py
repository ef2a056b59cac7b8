"""Packing token pieces into sequences: bounded-space online best fit.

A document is its ids and an end id; only one longer than a sequence is cut, its first
piece being the short one. Tokenising is one pass without a shuffle and leaves a narrow
table of pieces. Each packing task reads about `task_pieces` of them and holds at most
`open_bins` open sequences: a bitset has a bit for each free space that some open bin has,
so the tightest fit is its lowest bit at or above the length. When all bins are open the
fullest closes. A place is known as soon as a piece comes, so rows stream through.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.llm import tokens
from markweave.llm.common import few_rows, saved, text_of

LENGTH, OPEN_BINS, TASK_PIECES, END_ID = 2048, 4096, 200_000, 0


#: Where a row stands in the files of a table: file names of one write sort by length, then name.
PLACE = ["_file_size", "_file", "_row"]


def pieces(docs: DataFrame, length: int = LENGTH, in_order: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text is empty.

    in_order: docs is read from files, and PLACE comes along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            doc, out, counts = b.column(0).to_pylist(), ([], [], [], [], []), []
            for d, t in zip(doc, b.column(1), strict=True):
                ids = np.append(tokens.ids(t.as_py()), np.uint32(END_ID)).astype("<u4")
                start, cut = 0, len(ids) % length or length
                counts.append(-(-len(ids) // length))
                for i in range(counts[-1]):
                    for column, x in zip(out, (d, i, start, cut - start, crc32(ids[start:cut].tobytes())), strict=True):
                        column.append(x)
                    start, cut = cut, cut + length
            made = [pa.array(x, pa.int64() if i != 1 else pa.int32()) for i, x in enumerate(out)]
            row = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            yield pa.RecordBatch.from_arrays([*made, *(c.take(row) for c in b.columns[2:])], ["doc_id", "piece", "start", "length", "ids_crc32", *b.schema.names[2:]])

    schema, place = "doc_id long, piece int, start long, length long, ids_crc32 long", []
    if in_order:
        file = docs.metadataColumn("_metadata")
        schema += ", _file_size int, _file string, _row long"
        place = [x.alias(c) for x, c in zip((F.length(file["file_name"]), file["file_name"], file["row_index"]), PLACE, strict=True)]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), *place).mapInArrow(run, schema)


class BestFit:
    """Open bins by free space: bins[f] holds those with f free, bit f of `spaces` says that
    there is one."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.most = length, open_bins
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.spaces = self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1..length tokens."""
        fits = self.spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest closes
            free, sequence = self.length, self.made
            self.made += 1
        if free > size:
            self.bins[free - size].append(sequence)
            self.spaces |= 1 << (free - size)
            self.open += 1
        return sequence, self.length - free

    def _take(self, free: int) -> int:
        sequence = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces &= ~(1 << free)
        self.open -= 1
        return sequence


def pack(piece_rows: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES, in_order: bool = False) -> DataFrame:
    """Adds sequence_id and offset (long) to rows with a `length` of 1..length tokens.

    piece_rows should be a saved table: it is counted for the number of tasks. Rows are
    dealt round robin, so copies of one document spread over the tasks. in_order: rows are
    dealt by ranges of PLACE and placed as they come there, and sequence_id grows with it,
    up to what open bins take later; PLACE goes.
    """
    tasks = max(1, -(-piece_rows.count() // task_pieces))
    at = piece_rows.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(length, open_bins), TaskContext.get().partitionId() << 36
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column(at).to_numpy()
            # Of the rows at hand, the long ones first.
            order = np.arange(len(sizes)) if in_order else np.argsort(-sizes, kind="stable")
            where = np.empty((len(sizes), 2), np.int64)
            where[order] = [fit.place(n) for n in sizes[order].tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where[:, 0] + first), pa.array(where[:, 1])], [*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece_rows.schema) + ", sequence_id long, offset long"
    if in_order:
        by = [*PLACE, "piece"]
        return piece_rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, schema).drop(*PLACE)
    return piece_rows.repartition(tasks).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, in_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty and null texts are pieces of one token. An empty table gives no rows. Other
    columns of docs are not used, whatever their names. in_order: sequences follow the
    order of rows in the files that docs is read from.
    """
    return pack(saved(pieces(docs, length, in_order), "pieces"), length, open_bins, in_order=in_order)
