"""A table kept in the order of its key: merges rewrite only the files that hold a new key, and
a page reads only the files that can hold its rows.

Files are ranges of the key. A manifest, itself a table, has each file's least and greatest
key and its rows; the log names the manifest that counts. A merge writes new files, then a
new manifest, then puts an entry into the log by one rename: readers see all of it or
nothing, and what a lost writer left is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markweave.operators.numbering import sums_before
from markweave.sources.readers import last_of_each
from markweave.storage import delete, get, names, put, saved

ROWS_PER_FILE = 1_000_000


class KeyedTable:
    """Key columns are unique together and never NULL."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        shape = json.loads(get(spark, f"{self.root}/shape.json"))
        self.key, self.rows_per_file = shape["key"], shape["rows_per_file"]
        self.schema = T.StructType.fromJson(shape["schema"])

    @classmethod
    def create(cls, rows: DataFrame, root: str, key: list[str], rows_per_file: int = ROWS_PER_FILE) -> KeyedTable:
        """A table of rows in an empty folder."""
        shape = {"key": key, "rows_per_file": rows_per_file, "schema": rows.schema.jsonValue()}
        put(rows.sparkSession, f"{root.rstrip('/')}/shape.json", json.dumps(shape))
        table = cls(rows.sparkSession, root)
        table._commit(table._write(rows), None, [])
        return table

    # The log and the manifests.
    def _entries(self) -> list[str]:
        return [n for n in names(self.spark, f"{self.root}/log") if n.endswith(".json")]

    def version(self) -> str | None:
        """The manifest that counts."""
        found = self._entries()
        return json.loads(get(self.spark, f"{self.root}/log/{found[-1]}"))["manifest"] if found else None

    def manifest(self, version: str | None = None) -> DataFrame:
        """(file, low, high, rows) of the files of the table."""
        key = T.StructType([self.schema[k] for k in self.key])
        kind = T.StructType([T.StructField("file", T.StringType()), T.StructField("low", key), T.StructField("high", key), T.StructField("rows", T.LongType())])
        return self.spark.read.schema(kind).parquet(f"{self.root}/manifest/{version or self.version()}")

    def _key(self) -> Column:
        return F.struct(*self.key)

    def _value(self, r: tuple) -> Column:
        """A key as a constant."""
        return F.struct(*[F.lit(x).cast(self.schema[k].dataType).alias(k) for k, x in zip(self.key, r, strict=True)])

    def _write(self, rows: DataFrame) -> str:
        """New files, by ranges of the key; what they are called."""
        gen = uuid.uuid4().hex
        table = saved(rows, "merge")
        parts = max(1, -(-table.count() // self.rows_per_file))
        # Each task tells the driver of its work: a task writes many files, not one.
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        path = f"{self.root}/data/{gen}"
        if parts <= tasks:
            table.repartitionByRange(parts, *self.key).sortWithinPartitions(*self.key).write.parquet(path)
            return gen
        # Spark's ranges are nearly even, so each would end with a file of what is left over.
        # Cut at exact places, a key for each task, they are whole files.
        each = self.rows_per_file * -(-parts // tasks)
        places = sums_before(table.select(*self.key, F.lit(1).alias("_n")), self.key, "_n", "_i")
        cuts = places.where((F.col("_i") % each == 0) & (F.col("_i") > 0)).orderBy("_i").select(*self.key).collect()
        ends = F.array(*[self._value(r) for r in cuts])
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
        task = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(ends, n + step - 1) <= F.col("_k"), n + step).otherwise(n))
        dealt = table.withColumn("_k", self._key()).withColumn("_task", task).repartitionById(len(cuts) + 1, "_task").drop("_k", "_task")
        dealt.sortWithinPartitions(*self.key).write.option("maxRecordsPerFile", self.rows_per_file).parquet(path)
        return gen

    def _commit(self, gen: str, before: str | None, gone: list[str]) -> None:
        """The manifest without the files that are gone and with the new ones, then its entry."""
        new = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{gen}")
        file = F.concat(F.lit(f"{gen}/"), F.col("_metadata.file_name"))
        files = new.select(file.alias("file"), self._key().alias("k")).groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("rows"))
        if before is not None:
            files = self.manifest(before).where(~F.col("file").isin(gone) if gone else F.lit(True)).unionByName(files)
        files.coalesce(1).write.parquet(f"{self.root}/manifest/{gen}")
        number = int(self._entries()[-1].split(".")[0]) + 1 if before is not None else 0
        if self.version() != before or not put(self.spark, f"{self.root}/log/{number:08d}.json", json.dumps({"manifest": gen, "replaced": len(gone)})):
            raise RuntimeError(f"another writer has changed {self.root}; begin again")

    def _of(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{f}" for f in files]) if files else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows, as of the last entry."""
        return self._of([r.file for r in self.manifest().select("file").collect()])  # as Spark lists files

    def touched(self, keys: DataFrame) -> list[str]:
        """The files that hold one of the keys. Ranges rule most out; of the rest only the key
        columns are read."""
        ends = keys.agg(F.min(self._key()).alias("low"), F.max(self._key()).alias("high")).first()
        if ends.low is None:
            return []
        near = self.manifest().where((F.col("high") >= self._value(ends.low)) & (F.col("low") <= self._value(ends.high))).select("file").collect()
        rows = self._of([r.file for r in near])
        rows = rows.where((F.col(self.key[0]) >= F.lit(ends.low[0])) & (F.col(self.key[0]) <= F.lit(ends.high[0])))
        name = F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -2, 2))
        found = rows.select(*self.key, name.alias("_file")).join(keys.select(*self.key), self.key, "left_semi") if near else None
        return sorted(r[0] for r in found.select("_file").distinct().collect()) if near else []

    def merge(self, new: DataFrame, order: str | None = None) -> list[str]:
        """Rows of new take the place of those with their key, or are added; of repeated
        ones the last by the column `order` (which the table doesn't have) counts. The files
        that were rewritten."""
        before = self.version()
        last = new.withColumn("_k", self._key()).withColumn("_o", F.col(order) if order else F.struct(*new.columns))
        last = saved(last_of_each(last.select("_k", *self.schema.names, "_o"), "_k", "_o").drop("_k"), "new")
        gone = self.touched(last)
        stays = self._of(gone).join(last.select(*self.key), self.key, "left_anti").select(*self.schema.names)
        self._commit(self._write(stays.unionByName(last)), before, gone)
        return gone

    def page(self, after: tuple | None, n: int) -> tuple[DataFrame, list[str]]:
        """The n rows that follow a key, in order, and the files that they come from:
        the files that begin behind it and end first have n rows up to some key, so only files
        that begin before that one can hold rows of the page."""
        files = [(tuple(r.low), tuple(r.high), r.rows, r.file) for r in self.manifest().collect()]
        files = [f for f in files if after is None or f[1] > after]
        sure, end = 0, None
        for low, high, rows, _ in sorted(files, key=lambda f: f[1]):
            end = high
            sure += rows if after is None or low > after else 0
            if sure >= n:
                break
        chosen = [f[3] for f in sorted(files) if f[0] <= end]
        found = self._of(chosen)
        if after is not None:
            found = found.where(self._key() > self._value(after))
        return found.orderBy(*self.key).limit(n), chosen

    def clean(self) -> None:
        """Delete files and manifests that the last entry doesn't name. Not beside a writer."""
        version = self.version()
        held = {r.file.split("/")[0] for r in self.manifest().select("file").collect()}
        for n in names(self.spark, f"{self.root}/data"):
            if n not in held:
                delete(self.spark, f"{self.root}/data/{n}")
        for n in names(self.spark, f"{self.root}/manifest"):
            if n != version:
                delete(self.spark, f"{self.root}/manifest/{n}")
