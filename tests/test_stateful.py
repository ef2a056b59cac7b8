"""Streams of mark rows, in any order, against the batch over their last versions."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from markweave.operators import facets, linkage
from markweave.operators.filters import FilterSpec
from markweave.streaming import stateful

SCHEMA = "id string, application_number string, lineage_key string, certificate_number string, vn_grant_date date, publication_date date, mark_sample string, mark_name string, madrid_number string, nice_classes array<string>, version long, alive boolean"
WATCH = {"bolts": FilterSpec(q="bolt"), "class 5": FilterSpec(nice_class=("05",)), "none": FilterSpec(q="nothing has this")}


def versions(rng, n):
    """All versions of n rows; of marks of one to four rows, some of which go."""
    out = []
    for i in range(n):
        key = f"4-{i // rng.choice([1, 2, 4])}"
        for v in range(rng.randrange(1, 4)):
            cert, grant = rng.choice([None, f"C{i}"]), rng.choice([None, date(2024, 1, 1)])
            out.append((f"m{i:04d}", key, None, cert, grant, rng.choice([None, date(2024, 5, 1 + i % 28)]), rng.choice(["cold bolt", "BOLTER", "x", None]), None, None, rng.choice([None, ["05"], ["12", "05"]]), v, v == 0 or rng.random() < 0.8))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_add_up_to_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = versions(rng, 120)
    stream = rows + rng.sample(rows, 60)  # some come twice, all in any order
    rng.shuffle(stream)
    path = str(tmp_path / "in")
    for i in range(0, len(stream), 60):
        spark.createDataFrame(stream[i : i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second run finds nothing new
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        events = stateful.mark_events(source, WATCH, F.col("version"), F.col("alive"))
        stateful.mark_changes(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(stateful.CHANGE).parquet(out)
    last = {}
    for r in rows:
        if r[0] not in last or r[-2] > last[r[0]][-2]:
            last[r[0]] = r
    now = spark.createDataFrame([r for r in last.values() if r[-1]], SCHEMA)
    want = sorted(r.id for r in linkage.representatives(now).collect())
    assert sorted(r.id for r in stateful.representatives_of(changes).collect()) == want and 0 < len(want) < 120
    today = F.lit(date(2024, 6, 10))
    counts = {tuple(r) for r in facets.watch_counts(now, WATCH, today).collect() if r.total}
    assert {tuple(r) for r in stateful.watch_counts_of(changes, today).collect() if r.total} == counts and len(counts) == 2
    # Only what changed came out: a flag turns once each way, never twice to the same.
    for r in changes.where("kind = 'flag'").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("x")).collect():
        assert all(a.value != b.value for a, b in zip(r.x, r.x[1:], strict=False)) and r.x[0].value
    assert not list(changes.where("kind = 'watch' AND delta = 0").collect())
