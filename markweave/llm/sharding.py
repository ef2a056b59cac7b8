"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on a ring of 2^ring_bits cells (a hash of its id and content);
each shard has `virtual_nodes` places there. A row belongs to the first shard clockwise.
A shard takes no more than its share (row counts differ by one at most); rows beyond it
go on clockwise to the next shard with room. The walk is done on counts of cells, of
which there are 2^ring_bits whatever the input is; rows take part in one aggregation,
one window over their cell and one join on their cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markweave.llm.common import saved, text_of


#: Copies of one row that a task expands at once.
RUN = 100_000


def _owners(spark: SparkSession, shards: int, virtual_nodes: int, cells: int, open_shards: list[int]) -> DataFrame:
    """(cell, shard): the first virtual node clockwise of an open shard. cells rows."""
    nodes = (
        spark.range(shards * virtual_nodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
        .where(F.col("shard").isin(open_shards))
        .groupBy(F.pmod(F.xxhash64(F.lit("node"), "shard", "replica"), F.lit(cells)).alias("cell"))
        .agg(F.min("shard").alias("node"))
    )
    ring = spark.range(cells).select(F.col("id").alias("cell")).join(nodes, "cell", "left")
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    around = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ring.select(
        "cell",
        F.coalesce(F.last("node", True).over(ahead), F.last("node", True).over(around)).alias("shard"),
    )


def _walk(counts: DataFrame, shards: int, virtual_nodes: int, cells: int) -> DataFrame:
    """(cell, lo, hi, shard, base, hops): rows lo..hi-1 of a cell take the places from base
    in a shard. At most `shards` rounds, as each one fills a shard or leaves nothing over."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    used = dict.fromkeys(room, 0)
    left = counts.select("cell", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    placed, hops = None, 0
    while True:
        open_shards = [s for s in room if used[s] < room[s]]
        if not open_shards:
            break
        free = F.create_map(*[F.lit(x).cast(t) for s in open_shards for x, t in ((s, "int"), (room[s] - used[s], "long"))])
        start = F.create_map(*[F.lit(x).cast(t) for s in open_shards for x, t in ((s, "int"), (used[s], "long"))])
        order = Window.partitionBy("shard").orderBy("cell", "lo").rowsBetween(Window.unboundedPreceding, 0)
        tried = (
            left.join(_owners(spark, shards, virtual_nodes, cells, open_shards), "cell")
            .withColumn("before", F.sum(F.col("hi") - F.col("lo")).over(order) - (F.col("hi") - F.col("lo")))
            .withColumn("fit", F.greatest(F.lit(0), F.least(F.col("hi") - F.col("lo"), free[F.col("shard")] - F.col("before"))))
            .withColumn("base", start[F.col("shard")] + F.col("before"))
        )
        tried = saved(tried, "ring-round")
        got = tried.where("fit > 0").select("cell", "lo", (F.col("lo") + F.col("fit")).alias("hi"), "shard", "base", F.lit(hops).alias("hops"))
        placed = got if placed is None else placed.unionByName(got)
        for s, n in tried.groupBy("shard").agg(F.sum("fit")).collect():  # one row a shard
            used[s] += n
        left = tried.where("fit < hi - lo").select("cell", (F.col("lo") + F.col("fit")).alias("lo"), "hi")
        hops += 1
        if sum(used.values()) == total:
            break
    if placed is None:
        placed = left.select("cell", "lo", "hi", F.lit(0).alias("shard"), F.col("lo").alias("base"), F.lit(0).alias("hops")).limit(0)
    return placed


def shard_rows(rows: DataFrame, shards: int = 16, virtual_nodes: int = 64, ring_bits: int = 14) -> DataFrame:
    """Adds shard (int), slot (long, gapless from 0 in each shard) and hops (full shards
    passed over) to rows, which should be narrow: every column takes part in the hash.

    Rows equal in every column are counted once and expanded at the end, RUN copies at once,
    so one row that is repeated a billion times is one entry of one cell. Nulls hash like any value. An
    empty table gives an empty result. Fewer rows than shards leave shards empty.
    """
    cells, names = 1 << ring_bits, rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    placed = counted.withColumn("_h", F.xxhash64(*names)).withColumn("_cell", F.pmod(F.col("_h"), F.lit(cells)))
    counts = saved(placed.groupBy("_cell").agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).withColumnRenamed("_cell", "cell"), "ring-counts")
    walk = _walk(counts, shards, virtual_nodes, cells).select(*[F.col(c).alias(f"_{c}") for c in ("cell", "lo", "hi", "shard", "base", "hops")])
    order = Window.partitionBy("_cell").orderBy("_h", *names).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_first", F.sum("_n").over(order) - F.col("_n"))
    joined = ranked.join(walk, "_cell").where("_first < _hi and _first + _n > _lo")
    runs = joined.withColumn("_from", F.greatest("_first", "_lo")).withColumn("_to", F.least(F.col("_first") + F.col("_n"), F.col("_hi")) - 1)
    if (counts.agg(F.max("most")).first()[0] or 0) > RUN:  # a row that repeats so often is expanded by many tasks
        at = F.explode(F.sequence("_from", "_to", F.lit(RUN).cast("long")))
        runs = runs.withColumn("_from", at).withColumn("_to", F.least("_to", F.col("_from") + RUN - 1)).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = runs.withColumn("_rank", F.explode(F.sequence("_from", "_to")))
    return each.select(
        *names,
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("slot"),
        F.col("_hops").cast("int").alias("hops"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, virtual_nodes: int = 64) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot,
    grown_shard (null: this law looks at other rows too), hops. The law is `rows`.

    A null text has no bytes; a null doc_id hashes like any value. Other columns of docs are not used, whatever their names.
    """
    text = F.encode(text_of(docs), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, shards, virtual_nodes).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hops"
    )
