"""Incremental jobs: ingest, work-lists, outcome folds, watchlists on new rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The controllers' bounds.
WINDOW, FLOOR, CEILING, START, DEGRADE, PROBE, GIVE_UP = 20, 1, 6, 2, 0.70, 0.95, 3


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """ST01: new gazette rows, once each: the checkpoint remembers what was read, and write
    gets the batch's number to make its own effect repeatable."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: ST01, fixed values: what an ingest step makes of a gazette's status.
INGEST_STEPS = {
    ("uploaded", "start"): "processing",
    ("failed", "start"): "processing",
    ("processing", "start"): "processing",
    ("processing", "done"): "completed",
    ("processing", "error"): "failed",
}


def ingest_plan(files: DataFrame, gazettes: DataFrame) -> DataFrame:
    """ST01: (gazette_id, action) of files (gazette_id, sha256) against gazettes (gazette_id,
    sha256, status): `skip` what is completed with the same content, `retry` what an attempt
    left behind, `replace` what has other content, `new` what is unknown."""
    old = gazettes.select(F.col("gazette_id").alias("_g"), F.col("sha256").alias("_s"), "status")
    joined = files.join(old, files["gazette_id"] == F.col("_g"), "left")
    done = F.col("status") == "completed"
    action = F.when(F.col("_g").isNull(), "new").when(done & (F.col("sha256") == F.col("_s")), "skip").when(done, "replace").otherwise("retry")
    return joined.select("gazette_id", action.alias("action"))


def purge_partial(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """ST01: rows without those of gazettes that are read again, so that a retry after a
    crash leaves no row twice; one write of the result and the new rows is the commit."""
    again = plan.where(F.col("action").isin("retry", "replace")).select("gazette_id")
    return rows.join(again, "gazette_id", "left_anti")


def ingest_step(gazettes: DataFrame, event: str) -> DataFrame:
    """ST01: gazettes with the status that follows; a step that isn't legal leaves it."""
    out = F.col("status")
    for (status, what), following in INGEST_STEPS.items():
        if what == event:
            out = F.when(F.col("status") == status, following).otherwise(out)
    return gazettes.withColumn("status", out)


def work_list(universe: DataFrame, done: DataFrame, missing: DataFrame, key: str, now: Column, ttl_days: int = 30) -> DataFrame:
    """J08, ST02, ST05: keys neither done nor found missing within the time to live."""
    recent = missing.where(F.col("last_checked_at") >= now - F.make_dt_interval(F.lit(ttl_days)))
    keys = universe.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()
    return keys.join(done.select(key), key, "left_anti").join(recent.select(key), key, "left_anti")


def chunk(work: DataFrame, key: str, size: int) -> DataFrame:
    """ST02: the next keys of a work-list, in order."""
    return work.orderBy(key).limit(size)


def note_missing(missing: DataFrame, batch: DataFrame, key: str, now: Column) -> DataFrame:
    """ST05: the negative cache after a batch of misses: counts go up, times are renewed."""
    new = batch.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = missing.join(new, key, "full")
    return joined.select(
        key,
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(F.col("_hit"), now).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
        (F.coalesce("check_count", F.lit(0)) + F.coalesce("_hit", F.lit(False)).cast("int")).alias("check_count"),
    )


def prune_missing(missing: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """ST06: without keys that no row has any more."""
    return missing.join(universe.select(key).distinct(), key, "left_semi")


def streaks(outcomes: DataFrame, by: list[str], order: str, failed: Column, trip: int = 5) -> DataFrame:
    """W06, ST07: rows with the length of the failures up to them, and whether that trips."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = outcomes.withColumn("_ok", F.sum((~failed).cast("int")).over(upto))
    inside = Window.partitionBy(*by, "_ok").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("streak", F.sum(failed.cast("int")).over(inside)).withColumn("tripped", F.col("streak") >= trip).drop("_ok")


def window_tallies(outcomes: DataFrame, by: list[str], order: str, size: int = WINDOW) -> DataFrame:
    """Success, flaky and block of each window of outcomes, and its verdict."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    w = outcomes.withColumn("window", F.floor(n / size).cast("long"))
    good = F.count_if(F.col("outcome").isin("success", "not_found"))
    out = w.groupBy(*by, "window").agg(good.alias("success"), F.count_if(F.col("outcome") == "flaky").alias("flaky"), F.count_if(F.col("outcome") == "block").alias("block"))
    rate = F.try_divide("success", F.col("success") + F.col("flaky") + F.col("block"))
    verdict = F.when(F.col("block") > 0, "block").when(F.coalesce(rate, F.lit(0.0)) < DEGRADE, "ease").when(rate >= PROBE, "probe").otherwise("hold")
    return out.withColumn("verdict", verdict)


def concurrency(tallies: DataFrame, by: list[str]) -> DataFrame:
    """ST03: the level after all windows of a group, and whether three blocked ones in a row
    said to give up: a fold over the group's verdicts, one short word a window."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("window", "verdict"))), lambda z: z["verdict"])
    start = F.struct(F.lit(START).alias("level"), F.lit(0).alias("blocked"), F.lit(False).alias("given_up"))

    def step(s: Column, v: Column) -> Column:
        level = F.when(v == "block", F.greatest(F.lit(FLOOR), F.floor(s["level"] / 2).cast("int"))).when(v == "ease", F.greatest(F.lit(FLOOR), s["level"] - 1)).when(v == "probe", F.least(F.lit(CEILING), s["level"] + 1)).otherwise(s["level"])
        blocked = F.when(v == "block", s["blocked"] + 1).otherwise(0)
        stop = s["given_up"] | (blocked >= GIVE_UP)
        return F.when(s["given_up"], s).otherwise(F.struct(level.alias("level"), blocked.alias("blocked"), stop.alias("given_up")))

    return tallies.groupBy(*by).agg(F.aggregate(steps, start, step).alias("s")).select(*by, "s.level", "s.given_up")


def rate_level(budget_left: Column, level: Column, floor: float = 0.15, probe: float = 0.50, ceiling: int = CEILING) -> Column:
    """ST04: down to one below the floor, up above the probe line."""
    return F.when(budget_left < floor, 1).when(budget_left >= probe, F.least(F.lit(ceiling), level + 1)).otherwise(level)


#: ST09, fixed values: what a control may do from where.
TRANSITIONS = {
    ("idle", "start"): "running",
    ("running", "pause"): "paused",
    ("paused", "resume"): "running",
    ("running", "stop"): "stopping",
    ("paused", "stop"): "idle",
    ("stopping", "done"): "idle",
    ("running", "done"): "idle",
}


def transitions(spark: SparkSession) -> DataFrame:
    """ST09: the table of legal transitions; a request without a row is a conflict."""
    rows = ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in TRANSITIONS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(status, action, next)")


def sample_until(batches: DataFrame, margin: float = 0.02, floor: int = 200, ceiling: int = 1500, z: float = 1.96) -> DataFrame:
    """ST10: the first batch (batch, n, passed) after which the interval is narrow enough, or
    the ceiling is reached."""
    from markweave.functions.scoring import wilson

    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    run = batches.select("batch", F.sum("n").over(upto).alias("n"), F.sum("passed").over(upto).alias("passed"))
    done = (F.col("n") >= ceiling) | ((F.col("n") >= floor) & (wilson(F.col("passed"), F.col("n"), z)["half"] <= margin))
    return run.where(done).orderBy("batch").limit(1)


def watch_new_rows(stream: DataFrame, count: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """ST11: watchlist counts of each batch of new marks, from one scan of it."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(count(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FacetCache:
    """ST08: facet counts by (name, limit, filters that are set), renewed after a time to live.
    Counts are short lists; when `most` are held, all go. Nothing but time makes them stale."""

    def __init__(self, ttl: float = 120.0, most: int = 512, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.held: dict[tuple, tuple[float, list[Row]]] = {}

    def get(self, name: str, limit: int | None, filters: dict[str, object], count: Callable[[], DataFrame]) -> list[Row]:
        key = (name, limit, tuple(sorted((k, str(v)) for k, v in filters.items() if v is not None)))
        now, hit = self.clock(), self.held.get(key)
        if hit is not None and hit[0] > now:
            return hit[1]
        rows = count().collect()  # at most limit rows
        if len(self.held) >= self.most:
            self.held.clear()
        self.held[key] = (now + self.ttl, rows)
        return rows


def tumbling_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, on a batch or a stream; late rows count up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
