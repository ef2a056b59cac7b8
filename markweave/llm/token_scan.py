"""Token counts from flat token files by a separator scan.

A file is a run of 16-bit ids in which each document ends with an end id; there is no index
of where documents are. Tasks read byte ranges of files, of any size, in blocks that end
anywhere, and search each block for the end id at once; a prefix scan over the few numbers
of each block (ids, ends, last end) gives every document its number in the file and joins
those that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markweave.llm import tokens
from markweave.llm.common import few_rows, own_path, saved, text_of

#: Bytes of a block, and of the range that a task reads at a time.
BLOCK_BYTES, RANGE_BYTES = 1 << 20, 64 << 20


@contextmanager
def _opened(path: str, write: bool = False):
    """A file of any store that Arrow reaches, by its address."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if write:
        store.create_dir(at.rpartition("/")[0], recursive=True)
    f = store.open_output_stream(at) if write else store.open_input_file(at)
    try:
        yield f
    finally:
        f.close()


def write_token_files(docs: DataFrame, folder: str) -> DataFrame:
    """Flat files of all documents under folder, one for each task, and what is in them: (file,
    place, doc_id, bytes), a row for each document and, with place -1, for each file.

    A task that is run again writes another file, and only that of the attempt whose rows
    count is in the result. A null text is empty and has only its end. The end's own string
    in a text is ordinary text, so that no other id is an end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, size = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, 0

        def rows(ids: pa.Array, places: list[int], size: int | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file] * len(places)), pa.array(places, pa.int64()), ids, pa.array([size] * len(places), pa.int64())], ["file", "place", "doc_id", "bytes"])

        with _opened(file, write=True) as out:
            for b in few_rows(batches):
                for t in b.column(1):
                    size += out.write(np.append(tokens.ids(t.as_py(), ordinary=True), np.uint32(tokens.END)).astype("<u2").tobytes())
                yield rows(b.column(0), list(range(place, place + b.num_rows)), None)
                place += b.num_rows
        yield rows(pa.nulls(1, pa.int64()), [-1], size)

    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return saved(ids.mapInArrow(run, "file string, place long, doc_id long, bytes long"), "token-files")


def list_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files below path, which the driver lists as Spark does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, rows = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(sorted(rows), "file string, bytes long")


def scan_files(files: DataFrame, end: int = tokens.END, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, number, n_ids, ends): the places of the end id in each block of files (file,
    bytes). The last byte of an odd number is no id. Bytes stay in the task that reads them."""
    block = max(2, block_bytes // 2 * 2)
    blocks = max(1, range_bytes // block)  # of a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _opened(file) as f:
                    for number in range(first, min(first + blocks, -(-size // block))):
                        ids = np.frombuffer(f.read_at(min(block, size - number * block), number * block), "<u2")
                        ends = pa.array([np.flatnonzero(ids == end).astype(np.int32)], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), ends], ["file", "number", "n_ids", "ends"])

    even = files.select("file", (F.col("bytes") - F.col("bytes") % 2).alias("size")).where("size > 0")
    last = F.floor((F.col("size") - 1) / block)
    ranges = even.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(blocks).cast("long"))).alias("first"), "size")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "file", "first").mapInArrow(run, "file string, number long, n_ids long, ends array<int>")


def count_tokens(files: DataFrame, end: int = tokens.END, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, place, n_tokens, complete) of every document of flat files (file, bytes), by its
    place in the file; ids before an end, the end not counted. Ids after a file's last end are
    a last document that is not complete. Blocks without an end and files without ids are
    fine; a file that is listed twice is counted twice, and a null name is no file.
    """
    scanned = saved(scan_files(files.where("file IS NOT NULL"), end, block_bytes, range_bytes), "scan")
    before = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    spots = scanned.withColumn("at", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spots = spots.withColumn("place", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))
    spots = spots.withColumn("previous", F.coalesce(F.max(last).over(before), F.lit(-1).cast("long")))
    goes = F.expr("transform(ends, e -> at + e)")
    counts = F.expr("zip_with(goes, slice(concat(array(previous), goes), 1, size(goes)), (e, p) -> e - p - 1)")
    done = spots.withColumn("goes", goes).select("file", "place", F.posexplode(counts).alias("i", "n_tokens"))
    complete = done.select("file", (F.col("place") + F.col("i")).cast("long").alias("place"), "n_tokens", F.lit(True).alias("complete"))
    whole = spots.groupBy("file").agg(F.max(F.col("at") + F.col("n_ids")).alias("n"), F.max(F.col("place") + F.size("ends")).cast("long").alias("place"), F.max(F.coalesce(last, "previous")).alias("last"))
    rest = whole.select("file", "place", (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("complete")).where("n_tokens > 0")
    return complete.unionByName(rest)


def document_tokens(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and n_tokens (long) of every row, through flat token files of all documents in
    the shared folder. An empty or null text has none. Rows are counted one by one, so a null
    or repeated doc_id is fine. An empty table gives no rows. Other columns of docs are not
    used."""
    listed = write_token_files(docs, own_path(docs.sparkSession, "flat"))
    counts = count_tokens(listed.where("place < 0").select("file", "bytes"), block_bytes=block_bytes)
    inside = listed.where("place >= 0").select(F.col("file").alias("_f"), F.col("place").alias("_n"), "doc_id")
    return inside.join(counts, (F.col("_f") == F.col("file")) & (F.col("_n") == F.col("place"))).select("doc_id", "n_tokens")
