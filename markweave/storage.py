"""Tables in the folder that driver and executors share, and files put in place by a rename."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be broadcast after its rows were counted; more goes through a shuffle.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session has one; otherwise a temporary folder, which
    only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="markweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/markweave-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that later steps see the same rows
    whatever is lost or run again. codec: of Parquet, where the session's takes too much room."""
    path = scratch(df.sparkSession, what)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its rows stay within BROADCAST_BYTES, else with one for a
    shuffled join. df is counted, so it should be a table or cheap."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder, in order; none if it isn't there."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place as a whole, by a rename; False, and nothing done, if another
    writer has put one there."""
    fs, p = _at(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(p) and fs.rename(own, p):
        return True
    fs.delete(own, False)
    return False


def get(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


class Generations:
    """A folder of tables whose rows come in generations: <root>/<table>/gen=<id>/... A
    generation counts from the moment that its entry in <root>/log is put in place, by one
    rename; what a writer left behind before that is never read. An entry may replace others.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> list[dict]:
        log = f"{self.root}/log"
        return [json.loads(get(self.spark, f"{log}/{n}")) for n in names(self.spark, log) if n.endswith(".json")]

    def live(self) -> list[dict]:
        found = self.entries()
        gone = {g for e in found for g in e["replaces"]}
        return [e for e in found if e["gen"] not in gone]

    def begin(self) -> str:
        return uuid.uuid4().hex

    def write(self, gen: str, table: str, df: DataFrame, *by: str, codec: str | None = None) -> None:
        (df.write.option("compression", codec) if codec else df.write).partitionBy(*by).parquet(f"{self.root}/{table}/gen={gen}")

    def publish(self, gen: str, replaces: list[str] | None = None, **facts) -> None:
        """Entries are numbered, and a number is taken once: of two writers that saw the same
        state one has to begin again."""
        seen = names(self.spark, f"{self.root}/log")
        number = 1 + max((int(n.split(".")[0]) for n in seen if n.endswith(".json")), default=-1)
        if not put(self.spark, f"{self.root}/log/{number:08d}.json", json.dumps({"gen": gen, "replaces": replaces or []} | facts)):
            raise RuntimeError(f"another writer has published entry {number} of {self.root}")

    def read(self, table: str, schema: str) -> DataFrame:
        """The rows of all live generations; gen and other partition columns come last."""
        live = [e["gen"] for e in self.live()]
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}").where(F.col("gen").isin(live))

    def clean(self) -> list[str]:
        """Delete what no live generation holds; the ids that went. Not beside a writer."""
        live, gone = {e["gen"] for e in self.live()}, set()
        for table in names(self.spark, self.root):
            for n in names(self.spark, f"{self.root}/{table}") if table != "log" else ():
                if n.startswith("gen=") and n[4:] not in live:
                    delete(self.spark, f"{self.root}/{table}/{n}")
                    gone.add(n[4:])
        return sorted(gone)
