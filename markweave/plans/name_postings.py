"""A stored index of names: for each trigram, and for each sound, the list of names.

A list has (gram, name, size, place): the number of trigrams of the name, and which of them, in
alphabetical order, this one is. Lists are partitioned by a hash of the gram and sorted by
gram in their files, so a query reads its own lists only. Names that share enough trigrams
with a query are those that are in enough of its lists (T-occurrence); a name whose size
rules the similarity out, or whose remaining trigrams can't make it up, is dropped list by
list, before anything is counted. New names are a new generation of lists.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.functions import phonetics
from markweave.functions.scoring import set_overlap, text_trigrams, trigrams
from markweave.storage import Generations, exists, get, put

#: Partitions of the lists, by a hash of the gram or the sound.
BUCKETS = 32
GRAMS = "gram string, name string, size int, place int, gen string, bucket int"
CODES = "code string, name string, gen string, bucket int"
KNOWN = "name string, gen string"


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def need(size: Column, n: int, threshold: float) -> Column:
    """Trigrams that a name of `size` shares with a query of n at the threshold, at least:
    shared / (n + size - shared) >= threshold."""
    return F.ceil((n + size) * F.lit(threshold) / (1 + threshold) - F.lit(1e-9))


class NameIndex:
    """The index in a folder. All names of a marks table go in once; marks that are gone leave
    names that no mark bears, which do no harm and go with the next build()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.gens = spark, root.rstrip("/"), Generations(spark, root)
        self.buckets = json.loads(get(spark, f"{self.root}/shape.json"))["buckets"] if exists(spark, f"{self.root}/shape.json") else BUCKETS

    @classmethod
    def build(cls, names: DataFrame, root: str, buckets: int = BUCKETS) -> NameIndex:
        """An index of the names (name) in an empty folder."""
        put(names.sparkSession, f"{root.rstrip('/')}/shape.json", json.dumps({"buckets": buckets}))
        index = cls(names.sparkSession, root)
        index.add(names)
        return index

    def _write(self, names: DataFrame, replaces: list[str]) -> None:
        gen = self.gens.begin()
        self.gens.write(gen, "names", names)
        names = self.spark.read.schema("name string").parquet(f"{self.root}/names/gen={gen}")
        sets = names.select("name", F.array_sort(trigrams(F.col("name"))).alias("grams"))
        lists = sets.select(F.posexplode("grams").alias("place", "gram"), "name", F.size("grams").alias("size")).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        # By range, so that a long list is many tasks and files, each with few grams.
        self.gens.write(gen, "grams", lists.select("gram", "name", "size", "place", "bucket").repartitionByRange("bucket", "gram", "name").sortWithinPartitions("bucket", "gram", "name"), "bucket")
        codes = names.select(phonetics.metaphone(F.lower("name")).alias("code"), "name").withColumn("bucket", _bucket(F.col("code"), self.buckets))
        self.gens.write(gen, "codes", codes.repartitionByRange("bucket", "code", "name").sortWithinPartitions("bucket", "code", "name"), "bucket")
        self.gens.publish(gen, replaces)

    def names(self) -> DataFrame:
        return self.gens.read("names", KNOWN).select("name")

    def add(self, names: DataFrame) -> None:
        """Add the names (name) that the index doesn't hold; NULL is none."""
        fresh = names.select("name").where("name IS NOT NULL").distinct()
        self._write(fresh.join(self.names(), "name", "left_anti") if self.gens.live() else fresh, [])

    def compact(self) -> None:
        """All generations as one."""
        live = [e["gen"] for e in self.gens.live()]
        if len(live) > 1:
            self._write(self.names().distinct(), live)

    def lists(self, grams: list[str]) -> DataFrame:
        """(gram, name, size, place) of these lists; other partitions are not read."""
        numbers = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), self.buckets).alias("b"))
        wanted = sorted({r.b for r in numbers.collect()})  # of the query's few grams
        found = self.gens.read("grams", GRAMS)
        return found.where(F.col("bucket").isin(wanted) & F.col("gram").isin(grams)).select("gram", "name", "size", "place")

    def sharing(self, q: str, threshold: float) -> DataFrame:
        """(name, t) of names whose trigram similarity with q is at the threshold."""
        grams = text_trigrams(q)
        n = len(grams)
        if not n:
            return self.spark.createDataFrame([], "name string, t double")
        at = F.create_map(*[x for i, g in enumerate(grams) for x in (F.lit(g), F.lit(i))])[F.col("gram")]
        size, place = F.col("size"), F.col("place")
        most = F.least(at, place) + 1 + F.least(F.lit(n - 1) - at, size - place - 1)
        rows = self.lists(grams).where((size >= n * threshold) & (size <= n / threshold) & (most >= need(size, n, threshold)))
        counts = rows.groupBy("name", "size").agg(F.count("*").alias("c"))
        return counts.select("name", (F.col("c") / (n + size - F.col("c"))).alias("t")).where(F.col("t") >= threshold)

    def sounding(self, q: str) -> DataFrame:
        """(name, t) of names with the sound of q."""
        code = phonetics.double_metaphone(q.lower())[0][:4]
        bucket = self.spark.range(1).select(_bucket(F.lit(code), self.buckets).alias("b")).first().b
        found = self.gens.read("codes", CODES).where((F.col("bucket") == bucket) & (F.col("code") == code))
        grams = F.array(*map(F.lit, text_trigrams(q))).cast("array<string>")
        return found.select("name", set_overlap(trigrams(F.col("name")), grams).alias("t"))

    def recall(self, q: str, threshold: float) -> DataFrame:
        """(name, t) of names that share trigrams with q or sound like it, once each."""
        return self.sharing(q, threshold).unionByName(self.sounding(q)).groupBy("name").agg(F.max("t").alias("t"))

    def neighbours(self, anchors: DataFrame, threshold: float) -> DataFrame:
        """(anchor, name, similarity) of given names (anchor) against all others in the
        index. Each anchor's trigrams meet their lists; a list joins as many rows as anchors
        have its gram, so the work follows the anchors, not the square of a list."""
        own = anchors.select("anchor").where("anchor IS NOT NULL").distinct().withColumn("_g", F.array_sort(trigrams(F.col("anchor"))))
        asked = own.select("anchor", F.size("_g").alias("n"), F.posexplode("_g").alias("at", "gram"))
        size, place, n, at = (F.col(c) for c in ("size", "place", "n", "at"))
        most = F.least(at, place) + 1 + F.least(n - 1 - at, size - place - 1)
        least = F.ceil((n + size) * F.lit(threshold) / (1 + threshold) - F.lit(1e-9))
        met = asked.join(self.gens.read("grams", GRAMS).select("gram", "name", "size", "place"), "gram")
        near = met.where((size >= n * threshold) & (n >= size * threshold) & (most >= least) & (F.col("name") != F.col("anchor")))
        counts = near.groupBy("anchor", "name", "n", "size").agg(F.count("*").alias("c"))
        return counts.select("anchor", "name", (F.col("c") / (n + size - F.col("c"))).alias("similarity")).where(F.col("similarity") >= threshold)
