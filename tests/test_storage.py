"""Tables that are changed in place: generations, keyed merges, whole ingests."""

import random

import pytest
from pyspark.sql import functions as F

from markweave import storage
from markweave.functions.scoring import trigram_similarity
from markweave.plans.name_postings import NameIndex
from markweave.sources.keyed_table import KeyedTable
from markweave.streaming.ingest import Ingest


class Lost(Exception):
    """A writer that is killed."""


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_one_of_two_writers_puts(spark, tmp_path):
    path = f"{tmp_path}/log/1.json"
    assert storage.put(spark, path, "é") and not storage.put(spark, path, "b")
    assert storage.get(spark, path) == "é" and storage.names(spark, f"{tmp_path}/log") == ["1.json"]


def test_a_merge_rewrites_few_files(spark, tmp_path):
    old = spark.range(10_000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table = KeyedTable.create(old, f"{tmp_path}/t", ["k"], 250)
    assert table.manifest().count() == 40 and rows_of(table.read()) == [(i, "old") for i in range(10_000)]
    # One in a hundred keys, as a gazette's numbers follow each other; some come twice.
    new = spark.createDataFrame([(k, "first", 1) for k in range(5000, 5100)] + [(k, "last", 2) for k in range(5000, 5100, 2)], "k long, v string, o int")
    gone = table.merge(new, "o")
    want = {i: "old" for i in range(10_000)} | {k: "last" if k % 2 == 0 else "first" for k in range(5000, 5100)}
    assert len(gone) <= 4 and rows_of(table.read()) == sorted(want.items())
    # New keys rewrite nothing.
    assert table.merge(spark.createDataFrame([(-5, "new"), (20_000, "new")], "k long, v string")) == []
    want |= {-5: "new", 20_000: "new"}
    assert rows_of(table.read()) == sorted(want.items())
    assert table.merge(spark.createDataFrame([], "k long, v string")) == [] and rows_of(table.read()) == sorted(want.items())


def test_a_crash_before_the_entry_changes_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(spark.createDataFrame([(i, "old") for i in range(100)], "k long, v string"), f"{tmp_path}/t", ["k"], 10)
    new = spark.createDataFrame([(3, "new"), (500, "new")], "k long, v string")
    for what in ("put", "saved"):
        with monkeypatch.context() as m:
            m.setattr(f"markweave.sources.keyed_table.{what}", lambda *a: (_ for _ in ()).throw(Lost()))
            with pytest.raises(Lost):
                table.merge(new)
        assert rows_of(KeyedTable(spark, f"{tmp_path}/t").read()) == [(i, "old") for i in range(100)]
    assert len(table.merge(new)) == 1
    table.clean()
    want = sorted(({i: "old" for i in range(100)} | {3: "new", 500: "new"}).items())
    assert rows_of(KeyedTable(spark, f"{tmp_path}/t").read()) == want and len(storage.names(spark, f"{tmp_path}/t/data")) == 2
    # Of two writers that began from one state the second has to begin again.
    first, second = KeyedTable(spark, f"{tmp_path}/t"), KeyedTable(spark, f"{tmp_path}/t")
    before = second.version()
    first.merge(new)
    with pytest.raises(RuntimeError):
        second._commit(second._write(new), before, [])


def test_pages_read_their_files(spark, tmp_path):
    rng = random.Random(1)
    keys = [(rng.randrange(300), f"m{i:04d}") for i in range(3000)]
    table = KeyedTable.create(spark.createDataFrame(keys, "day int, id string"), f"{tmp_path}/t", ["day", "id"], 150)
    table.merge(spark.createDataFrame([(d, f"n{d}") for d in range(0, 300, 30)], "day int, id string"))
    want = sorted(keys + [(d, f"n{d}") for d in range(0, 300, 30)])
    after, got = None, []
    while True:
        page, files = table.page(after, 100)
        rows = [tuple(r) for r in page.collect()]
        if not rows:
            break
        assert len(files) <= 4
        got, after = got + rows, rows[-1]
    assert got == want
    base = KeyedTable.create(spark.createDataFrame(keys, "day int, id string"), f"{tmp_path}/u", ["day", "id"], 150)
    assert all(len(base.page(k, 100)[1]) <= 2 for k in sorted(keys)[::271])


NAMES = "id long, name string"


def test_ingest_is_whole_or_nothing(spark, tmp_path):
    log = Ingest(spark, f"{tmp_path}/i", NAMES)
    assert log.rows().isEmpty() and log.gazettes().isEmpty()
    rows = lambda n, v="a": lambda: spark.createDataFrame([(i, v) for i in range(n)], NAMES).repartition(3)
    assert log.run("g1", "h1", rows(5)) == "completed" and log.run("g1", "h1", rows(9)) == "skip"
    assert log.run("g2", "h2", rows(0)) == "completed"

    def crash():
        # The last of three tasks fails after the others have written.
        bad = F.udf(lambda i: 1 // (i != 8) and "x", "string")
        return spark.range(0, 9, 1, 3).select("id", bad("id").alias("name"))

    for gazette in ("g3", "g1"):
        with pytest.raises(Exception, match="ZeroDivision"):
            log.run(gazette, "h3", crash)
    status = {r.gazette_id: (r.status, r.row_count, "ZeroDivision" in (r.error or "")) for r in log.gazettes().collect()}
    assert status == {"g1": ("failed", 0, True), "g2": ("completed", 0, False), "g3": ("failed", 0, True)} and log.rows().isEmpty()
    assert log.run("g3", "h3", rows(4)) == "completed" and log.run("g1", "h1", rows(5, "b")) == "completed"
    assert rows_of(log.rows().groupBy("gazette_id", "name").count()) == [("g1", "b", 5), ("g3", "a", 4)]
    log.purge("g3")
    assert rows_of(log.rows().groupBy("gazette_id").count()) == [("g1", 5)] and log.clean() == []


def test_a_killed_attempt_is_never_read(spark, tmp_path, monkeypatch):
    log = Ingest(spark, f"{tmp_path}/i", NAMES)
    rows = lambda: spark.createDataFrame([(1, "a"), (2, "b")], NAMES)
    log.run("g1", "h1", rows)
    real = log.gens.publish

    def killed(gen, replaces=None, **facts):
        if facts["status"] != "processing":
            raise KeyboardInterrupt  # as a kill: no handler of errors sees it
        real(gen, replaces, **facts)

    with monkeypatch.context() as m:
        m.setattr(log.gens, "publish", killed)
        for gazette, sha in (("g2", "h2"), ("g1", "new")):
            with pytest.raises(KeyboardInterrupt):
                log.run(gazette, sha, rows)
    again = Ingest(spark, f"{tmp_path}/i", NAMES)
    assert {r.gazette_id: r.status for r in again.gazettes().collect()} == {"g1": "processing", "g2": "processing"} and again.rows().isEmpty()
    assert again.run("g2", "h2", rows) == "completed" and again.run("g1", "new", rows) == "completed"
    assert rows_of(again.rows().groupBy("gazette_id").count()) == [("g1", 2), ("g2", 2)]
    again.clean()
    assert len(storage.names(spark, f"{tmp_path}/i/rows")) == 2 and again.rows().count() == 4


def test_name_lists(spark, tmp_path):
    rng = random.Random(3)
    words = ["cold", "bolt", "colt", "nguyễn", "a", "zz", "bolter", "tôi"]
    names = sorted({" ".join(rng.choice(words) + rng.choice(["", "s", "x"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)} | {"", "--", "123"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    index = NameIndex.build(df.limit(200).union(df.limit(200)), f"{tmp_path}/n", 4)
    # The rest in a second generation; what is known already adds nothing.
    with pytest.raises(Lost), pytest.MonkeyPatch.context() as m:
        m.setattr(index.gens, "publish", lambda *a, **k: (_ for _ in ()).throw(Lost()))
        index.add(df)
    index = NameIndex(spark, f"{tmp_path}/n")
    assert index.names().count() == 200
    index.add(df)
    index.add(df)
    for compacted in (False, True):
        if compacted:
            index.compact()
            index.gens.clean()
        assert sorted(r.name for r in index.names().collect()) == names
        for q in ("cold bolt", "nguyễn", "zz", "?"):
            for t in (0.15, 0.5, 1.0):
                want = df.select("name", trigram_similarity(F.col("name"), F.lit(q)).alias("t")).where(F.col("t") >= t)
                assert rows_of(index.sharing(q, t)) == rows_of(want), (q, t)
        pairs = df.alias("x").join(df.alias("y"), F.col("x.name") != F.col("y.name")).where("x.name IN ('cold bolt', 'zz', 'colts a', '123')")
        want = pairs.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), trigram_similarity(F.col("x.name"), F.col("y.name")).alias("t")).where("t >= 0.15")
        anchors = df.where("name IN ('cold bolt', 'zz', 'colts a', '123')").select(F.col("name").alias("anchor"))
        assert rows_of(index.neighbours(anchors, 0.15)) == rows_of(want)
    plan = index.sharing("cold bolt", 0.15)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "bucket" in scan[: scan.index("PushedFilters")] and "In(gram" in scan


def test_rollups_read_one_gazette(spark, tmp_path):
    from markweave.operators import facets, linkage
    from markweave.operators.rollup import Rollup

    rng = random.Random(9)
    kinds = [("A", "domestic_application"), ("B_domestic", "domestic_registration"), ("B_madrid", "madrid_renewal")]
    rows = [(f"m{i}", f"g{rng.randrange(4)}", rng.choice([None, f"4-{rng.randrange(900)}"]), None, 2019 + rng.randrange(3), *rng.choice(kinds)) for i in range(4000)]
    marks = spark.createDataFrame(rows, "id string, gazette_id string, application_number string, lineage_key string, year int, record_type string, mark_category string").cache()
    rollup = Rollup(spark, f"{tmp_path}/r")
    assert rollup.distinct_counts().first().n == 0 and rollup.year_streams().isEmpty()

    def whole(of):
        now = marks.where(F.col("gazette_id").isin(of))
        assert rows_of(rollup.year_streams()) == rows_of(facets.year_streams(now))
        exact = {r.record_type: r.n for r in facets.distinct_counts(now.withColumn("k", linkage.dedup_key()), "k", "record_type").collect()}
        assert {r.record_type: r.n for r in rollup.distinct_counts().collect()} == exact
        assert all(abs(r.n - exact[r.record_type]) <= 0.03 * exact[r.record_type] for r in rollup.sketched_counts().collect())

    for g in ("g0", "g1", "g2"):
        rollup.put(g, marks.where(F.col("gazette_id") == g))
    whole(["g0", "g1", "g2"])
    # A gazette that comes in is all that is read: the others' marks may be gone.
    seen = marks.where("gazette_id = 'g3'").withColumn("year", F.when(F.col("gazette_id") != "g3", F.raise_error(F.lit("read"))).otherwise(F.col("year")))
    rollup.put("g3", seen)
    rollup.put("g3", seen)
    whole(["g0", "g1", "g2", "g3"])
    rollup.drop("g1")
    whole(["g0", "g2", "g3"])
    assert len(rollup.gens.clean()) >= 2
    whole(["g0", "g2", "g3"])
