"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and \t \n \v \f \r.
WS = r"\x20\x09-\x0D"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session
    has one; otherwise a temporary folder, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="markweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/markweave-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all that saved() wrote in this application. Results that aren't written yet read
    from there, so this comes after them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def own_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else has; clear() deletes what is there."""
    return f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, so a lost
    executor costs a reread, never a recomputation of what came before. clear() deletes it."""
    spark = df.sparkSession
    path = own_path(spark, what)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What may be broadcast after its size was measured; more goes through a shuffle.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, bytes_of: Column) -> DataFrame:
    """df, a saved table, with a broadcast hint if the sum of bytes_of stays within
    BROADCAST_BYTES, else with one for a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(bytes_of)).first()[0] or 0) <= BROADCAST_BYTES else df.hint("merge")


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with its own columns of these names under others, and what selects all of its
    columns back, for an operator that adds columns of these names."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(docs[column], F.lit(""))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what a task builds for one stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
