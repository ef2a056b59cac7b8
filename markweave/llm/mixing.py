"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. With its weight as q slots of every Q, its k-th block of a
period is released at floor(kQ/q) and due at ceil((k+1)Q/q); earliest deadline first, among
released blocks, meets every deadline when the weights fill the period, so that a source is
always less than one block from its share. One period of Q slots is scheduled (Q and the
number of weights are parameters, not data) and repeats for ever, so a block's slot is a
lookup and no task ever sees the whole schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markweave.llm.common import set_aside

#: Production weights; sources that are not named share REST.
WEIGHTS = {"src0": 20.0} | {f"src{i}": 5.0 for i in range(1, 10)} | {f"src{i}": 3.0 for i in range(10, 20)}
REST, PERIOD, BLOCK, SEED = 5.0, 100, 32, 17
ADDED = ("mix_class", "mix_block", "mix_slot", "mix_offset", "mix_epoch")


def quotas(weights: dict[str, float], rest: float, period: int) -> list[tuple[str | None, int]]:
    """Slots of each class in a period, by largest remainder, one at least; None is the rest."""
    names: list[str | None] = [*sorted(weights), None]
    raw = [max(0.0, weights[n] if n is not None else rest) for n in names]
    if period < len(names) or not sum(raw):
        raise ValueError("the period needs a slot for each weight, and a weight above zero")
    exact = [w * period / sum(raw) for w in raw]
    got = [max(1, int(x)) for x in exact]
    order = sorted(range(len(names)), key=lambda i: (got[i] - exact[i], i))
    while sum(got) < period:
        got[order[0]] += 1
        order.sort(key=lambda i: (got[i] - exact[i], i))
    while sum(got) > period:
        most = max((i for i in range(len(got)) if got[i] > 1), key=lambda i: (got[i] - exact[i], i))
        got[most] -= 1
    return list(zip(names, got, strict=True))


def period_schedule(spark: SparkSession, q: list[int], period: int) -> DataFrame:
    """(class, k, slot): earliest deadline first over one period, as one SQL fold."""
    n, big = len(q), 10 * period * period
    quota = f"array({','.join(map(str, q))})"
    return spark.sql(f"""
        SELECT class, k, slot FROM (
          SELECT aggregate(
            sequence(0, {period - 1}),
            struct(array_repeat(0, {n}) AS done, cast(array() AS array<struct<class:int,k:int,slot:int>>) AS plan),
            (s, t) -> aggregate(
              array(array_position(transform({quota}, (q, i) -> IF(s.done[i] * {period} div q <= t,
                    cast(((s.done[i] + 1) * {period} + q - 1) div q AS bigint), {big}L)),
                    array_min(transform({quota}, (q, i) -> IF(s.done[i] * {period} div q <= t,
                    cast(((s.done[i] + 1) * {period} + q - 1) div q AS bigint), {big}L))))),
              s,
              (z, p) -> struct(
                transform(z.done, (d, i) -> IF(i = p - 1, d + 1, d)) AS done,
                concat(z.plan, array(struct(cast(p - 1 AS int) AS class, z.done[cast(p - 1 AS int)] AS k, t AS slot))) AS plan))
          ).plan AS plan)
        LATERAL VIEW inline(plan) v AS class, k, slot""")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    rest: float = REST,
    period: int = PERIOD,
    block: int = BLOCK,
    seed: int = SEED,
    size: Column | None = None,
    epochs: int | None = None,
) -> DataFrame:
    """Adds mix_class (int), mix_block, mix_slot and mix_offset (long) to all rows of docs,
    which come back whole; ordered by (mix_slot, mix_offset), every prefix of slots holds
    each source within one block of its share until a source ends. A source that ends early
    leaves its slots empty and the others keep their proportions.

    size: what a row weighs (bytes or tokens; null and less than one as one); a block then
    holds rows that begin within `block` of it, so the shares are of that in place of rows,
    and off by at most one row more. epochs: if given, the mixture ends where the first
    source that has rows was used up so many times, and sources with fewer rows repeat until
    then; so the weights hold to the end, at the price of rows that come again (mix_epoch
    counts from 0, and is there only then) or not at all.

    A null source, or one without a weight, belongs to the rest. Within a source the order
    is that of md5(doc_id, seed), with a hash of the row for a null id; ties come by id, then by
    a hash of the row, so that a rerun gives rows that share an id the same places. Places are
    counted by cells of three hex digits of that md5, so a source with a third of all rows is
    4096 windows, not one; rows that share an id share a cell. Columns of docs that already
    have one of the five names are replaced.
    """
    spark = docs.sparkSession
    q = quotas(WEIGHTS if weights is None else weights, rest, period)
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    cls = F.lit(len(q) - 1)
    for i, (name, _) in enumerate(q[:-1]):
        cls = F.when(docs["source"] == name, i).otherwise(cls)
    tie = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if c in keep and "map<" not in kind and "variant" not in kind])
    rows = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("_row"),
        cls.alias("mix_class"),
        docs["doc_id"].alias("_id"),
        tie.alias("_tie"),
        F.md5(F.concat_ws("#", F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("null"), tie.cast("string"))), F.lit(str(seed)))).alias("_h"),
        (F.lit(1).cast("long") if size is None else F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1))).alias("_size"),
    ).withColumn("_cell", F.substring("_h", 1, 3))
    counts = rows.groupBy("mix_class", "_cell").agg(F.sum("_size").alias("_n"))
    before = Window.partitionBy("mix_class").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("mix_class")
    bases = counts.select("mix_class", "_cell", (F.sum("_n").over(before) - F.col("_n")).alias("_base"), F.sum("_n").over(whole).alias("_whole"))
    inside = Window.partitionBy("mix_class", "_cell").orderBy("_h", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    quota = F.element_at(F.array(*[F.lit(n) for _, n in q]), F.col("mix_class") + 1)
    plan = period_schedule(spark, [n for _, n in q], period).select(F.col("class").alias("mix_class"), F.col("k").cast("long").alias("_k"), "slot")

    def placed(df: DataFrame, at: str) -> DataFrame:
        """df with the slot of the block that holds the place `at`."""
        cut = df.withColumn("mix_block", F.floor(F.col(at) / block)).withColumn("_k", F.col("mix_block") % quota)
        slots = cut.join(F.broadcast(plan), ["mix_class", "_k"])  # `period` rows
        return slots.withColumn("mix_slot", F.floor(F.col("mix_block") / quota) * period + F.col("slot")).drop("slot", "_k")

    ranked = rows.withColumn("_in", F.sum("_size").over(inside) - F.col("_size")).join(bases, ["mix_class", "_cell"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    own = [F.col("_row")[c].alias(c) for c in keep]
    added = ["mix_class", "mix_block", "mix_slot", (F.col("_rank") % block).alias("mix_offset")]
    if epochs is None:
        return placed(ranked, "_rank").select(*own, *added)
    # One row a class: the slot of its last place, if it is used up so many times.
    totals = counts.groupBy("mix_class").agg((F.sum("_n") * epochs - 1).alias("_last"))
    end = placed(totals, "_last").agg(F.min("mix_slot")).first()[0] or 0
    # A class has its quota of blocks in each period, so the end bounds its rounds.
    most = F.floor((end // period + 1) * quota * block / F.col("_whole")).cast("int")
    again = ranked.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), most))).withColumn("_rank", F.col("_rank") + F.col("mix_epoch") * F.col("_whole"))
    return placed(again, "_rank").where(F.col("mix_slot") <= end).select(*own, *added, "mix_epoch")


def mixed_order(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, laid out in mixed order: files follow one another by slot. All columns
    of docs stay, whatever their names."""
    docs, back = set_aside(docs, *ADDED)
    mixed = mix_sources(docs, **params)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = mixed.repartitionByRange(parts, "mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset", "mix_class")
    return laid.select(*back)
