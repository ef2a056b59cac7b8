"""What the findings of round 3 asked for."""

from pyspark.sql import functions as F

from markweave.functions import html
from markweave.operators import facet_index, layout, linkage, numbering
from markweave.operators.rollup import Rollup
from markweave.sources.keyed_table import KeyedTable
from markweave.streaming import stateful


def test_page_values_are_worked_out_once(spark):
    pages = spark.createDataFrame([("<p>A &amp; &#66;</p>",)], "page string")
    row = pages.select(html.flat(html.details(F.col("page"), r"\(541\)")).alias("none"), html.flat(F.col("page")).alias("text"))
    assert tuple(row.first()) == (None, "A & B")
    plan = row.select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)<[^>]*>") == 1
    lines = pages.select(html.value_after(F.split("page", "&"), "732").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count(r"^\d{3}$") == 1


def test_short_rows_are_spread(spark):
    rows = layout.spread(spark.range(1000, numPartitions=1))
    assert [n > 100 for n in rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()] == [True] * 4


def test_marks_share_a_bucket_of_state(spark, tmp_path):
    schema = "key string, id string, version long, alive boolean, certificate boolean, granted boolean, lists string, day int"
    turns = [
        [("k1", "a", 1, True, False, False, "x\ny", None), ("k2", "b", 1, True, True, False, "", 3)],
        [("k1", "c", 1, True, True, False, "x", 5), ("k1", "a", 2, False, False, False, "x", None), ("k3", "d", 1, True, False, True, "y", 7)],
        [("k1", "a", 1, True, True, True, "y", 1)],  # late
    ]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in turns:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    stateful.mark_changes(stream, buckets=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(stateful.CHANGE).parquet(out)
    assert sorted(r.id for r in stateful.representatives_of(changes).collect()) == ["b", "c", "d"]
    assert {tuple(r) for r in changes.where("kind = 'watch'").groupBy("name", F.unix_date("day").alias("day")).agg(F.sum("delta").alias("n")).where("n <> 0").collect()} == {("x", 5, 1), ("y", 7, 1)}
    assert sorted((r.id, r.value) for r in changes.where("kind = 'flag'").collect()) == [("a", False), ("a", True), ("b", True), ("c", True), ("d", True)]


def test_rows_without_a_number_are_spread(spark):
    rows = spark.createDataFrame([(f"i{i}", None if i % 2 else "") for i in range(400)] + [("x", "4-1")], "id string, number string")
    records = spark.createDataFrame([("4-1", "one"), ("", "blank")], "key string, name string").hint("merge")
    got = linkage.with_record(rows, "number", records, "key")
    assert sorted({(r.number, r.name) for r in got.collect()}, key=str) == sorted({(None, None), ("", "blank"), ("4-1", "one")}, key=str) and got.count() == 401
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sizes = linkage.with_record(rows, "number", records, "key").rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(sizes) == 4 and max(sizes) < 200


def test_purge_reads_marks_once(spark):
    schema = "id string, gazette_id string, application_number string, lineage_key string, certificate_number string, vn_grant_date date"
    marks = spark.createDataFrame([("a", "g1", "4-1", None, None, None), ("b", "g2", "4-1", None, "C", None), ("c", "g1", "4-2", None, None, None), ("d", None, "", "", None, None)], schema)
    purged = linkage.purge(linkage.with_representative(marks), "g2")
    assert {(r.id, r.is_representative) for r in purged.collect()} == {("a", True), ("c", True), ("d", True)}
    assert purged._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_a_task_writes_many_files(spark, tmp_path):
    table = KeyedTable.create(spark.range(1000).withColumnRenamed("id", "k"), str(tmp_path / "t"), ["k"], 10)
    files = table.manifest().collect()
    assert len(files) >= 100 and max(r.rows for r in files) <= 10 and table.read().count() == 1000
    assert len({r.file.split("/")[1].split("-")[1] for r in files}) <= 4  # the tasks that wrote them


def test_rollup_takes_rows_with_their_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "c", "A", "k1"), (1, "c", "A", "k1"), (2, "c", "B", "k1")], "year int, mark_category string, record_type string, key string")
    rollup = Rollup(spark, str(tmp_path / "r"))
    rollup.put("g", rows)
    assert {tuple(r) for r in rollup.distinct_counts().collect()} == {("A", 1), ("B", 1), (None, 1)}


def test_index_entries_are_made_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3 == 0, None if i == 5 else f"v{i % 2}") for i in range(32_760, 32_790)], "_i long, _rep boolean, f string").coalesce(1)
    bits = rows.mapInArrow(facet_index._pieces(True), "field string, value string, bucket long, n long, bits binary")
    assert "Exchange hashpartitioning" not in bits._jdf.queryExecution().executedPlan().toString()
    got = {(r.value, r.bucket): (r.n, r.c) for r in bits.select("value", "bucket", "n", F.bitmap_count("bits").alias("c")).collect()}
    assert got == {("v0", 1): (2, 4), ("v1", 1): (1, 4), ("v0", 2): (3, 11), ("v1", 2): (4, 11)}
    lists = rows.mapInArrow(facet_index._pieces(False), "field string, value string, bucket long, n long, rows array<int>")
    assert {(r.value, r.bucket): r.rows[0] for r in lists.collect()} == {("v0", 1): 32760, ("v1", 1): 32761, ("v0", 2): 0, ("v1", 2): 1}
    numbers = numbering.placed(spark.range(100, numPartitions=3)).collect()
    assert sorted(r._i for r in numbers) == list(range(100))


def test_logo_paths_without_a_join_back(spark):
    schema = "id string, application_number string, certificate_number string, madrid_number string"
    rows = [("a", "1", None, None), ("b", "", "2", None), ("c", "9", "2", "3"), ("c", "9", "2", "3"), ("d", None, None, "3"), ("e", None, None, None), ("f", "", "", ""), ("f", "", "", ""), ("g", "3", "9", "9"), ("h", "9", "8", None), ("i", None, None, "4"), (None, "1", None, None)]
    files = [("1", "p/1"), ("2", "p/2b"), ("2", "p/2a"), ("3A", "p/3A"), ("4A", "p/4A"), ("4", "p/4")]
    marks = spark.createDataFrame(rows, schema)
    out = layout.logo_path(marks, spark.createDataFrame(files, "stem string, path string"))
    want = [("a", "p/1"), ("b", "p/2a"), ("c", "p/2a"), ("c", "p/2a"), ("d", "p/3A"), ("e", None), ("f", None), ("f", None), ("g", None), ("h", None), ("i", "p/4"), (None, "p/1")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    # One join, by number, in each of the two parts; none by id.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "(id#" not in "".join(x.split("Join LeftOuter,", 1)[1] for x in plan.splitlines() if "Join LeftOuter," in x)
