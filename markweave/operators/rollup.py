"""Counts that are kept by gazette and merged when they are read.

A gazette's rows are read once, when it comes: its cells hold counts by year, category and
kind, and a sketch of its mark keys for each; its distinct keys are kept beside them. A
gazette that comes again takes the place of its cells. Sums and sketches of all gazettes add
up from the cells, which are few; exact distinct counts read the kept keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.operators.linkage import dedup_key
from markweave.storage import Generations

#: Sketches have 2^LOG_K registers: a standard error of some 1.04 / sqrt(2^LOG_K), 0.8 %.
LOG_K = 14
CELLS = "year int, mark_category string, record_type string, n long, sketch binary, gen string"
KEYS = "record_type string, key string, gen string, bucket int"
BUCKETS = 16


class Rollup:
    """The cells of gazettes in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.gens = spark, Generations(spark, root)

    @staticmethod
    def columns(rows: DataFrame, *more: str) -> DataFrame:
        """What a rollup needs of marks; rows of it have their key already."""
        return rows.select("year", "mark_category", "record_type", ("key" if "key" in rows.columns else dedup_key().alias("key")), *more)

    def put(self, gazette_id: str, rows: DataFrame) -> None:
        """Take in a gazette's marks, in the place of what it had; no other gazette is read."""
        old = [e["gen"] for e in self.gens.live() if e["gazette_id"] == gazette_id]
        gen = self.gens.begin()
        keyed = self.columns(rows)
        cells = keyed.groupBy("year", "mark_category", "record_type").agg(F.count("*").alias("n"), F.hll_sketch_agg("key", LOG_K).alias("sketch"))
        self.gens.write(gen, "cells", cells)
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        self.gens.write(gen, "keys", keyed.select("record_type", "key").distinct().withColumn("bucket", bucket), "bucket")
        self.gens.publish(gen, old, gazette_id=gazette_id)

    def drop(self, gazette_id: str) -> None:
        """Take a gazette out."""
        old = [e["gen"] for e in self.gens.live() if e["gazette_id"] == gazette_id]
        gen = self.gens.begin()
        self.gens.publish(gen, [*old, gen], gazette_id=gazette_id)

    def cells(self) -> DataFrame:
        return self.gens.read("cells", CELLS)

    def year_streams(self) -> DataFrame:
        """A10: as facets.year_streams over all marks."""
        streams = {"applications": "domestic_application", "registrations": "domestic_registration", "madrid": "madrid_registration", "renewals": "madrid_renewal"}
        of = lambda v: F.coalesce(F.sum(F.when(F.col("mark_category") == v, F.col("n"))), F.lit(0)).cast("long")
        return self.cells().groupBy("year").agg(*[of(v).alias(k) for k, v in streams.items()])

    def overview(self) -> DataFrame:
        """Counts by kind and category."""
        return self.cells().groupBy("record_type", "mark_category").agg(F.sum("n").alias("n"))

    def distinct_counts(self) -> DataFrame:
        """(record_type, n), exact: marks by kind, and over all (NULL), to which the kinds
        don't add up."""
        keys = self.gens.read("keys", KEYS).select("record_type", "key")
        by = keys.groupBy("record_type").agg(F.count_distinct("key").alias("n"))
        return by.unionByName(keys.agg(F.lit(None).cast("string").alias("record_type"), F.count_distinct("key").alias("n")))

    def sketched_counts(self) -> DataFrame:
        """A12 from the sketches alone: within some 2 % (see LOG_K), whatever the size."""
        cells = self.cells()
        n = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")
        return cells.groupBy("record_type").agg(n).unionByName(cells.agg(F.lit(None).cast("string").alias("record_type"), n))
