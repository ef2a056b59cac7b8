"""Tests of the findings of round 4."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from markweave import roles
from markweave.operators import facet_index, linkage, numbering
from markweave.operators.facet_index import FacetIndex
from markweave.operators.filters import FilterSpec
from markweave.sources.keyed_table import KeyedTable

COLUMNS = "id string, application_number string, lineage_key string, certificate_number string, vn_grant_date date, applicant_country_code string, mark_category string, record_type string, applicant_type string, year int, month int, nice_classes array<string>, applicant_name string, ip_agency string, gazette_id string, vienna_codes array<string>"


def some_marks(spark, n=400):
    """Keys that come once, twice and often, by application number, lineage or not at all."""
    i = F.col("i")
    app = F.when(i % 5 == 0, F.lit("")).when(i % 5 < 3, F.concat(F.lit("4-"), i % 90))
    lineage = F.when(i % 7 == 0, F.lit("")).when(i % 7 < 5, F.concat(F.lit("4-"), i % 60)).when(i % 7 == 5, F.lit("L"))
    values = [F.format_string("m%05d", (i * 7919) % n), app, lineage, F.when(i % 3 == 0, F.lit("c")), F.when(i % 4 == 0, F.lit("2020-01-01").cast("date")), F.when(i % 2 == 0, F.lit("VN")).otherwise("US"), F.lit("c"), F.when(i % 3 < 2, "A").otherwise("B"), F.lit("x"), i % 3, i % 2, F.array(F.lit("05"), F.when(i % 9 == 0, "05").otherwise("12")), F.concat(F.lit("o"), i % 11), F.concat(F.lit("a"), i % 13), F.lit("g"), F.array(F.lit("5.7"))]
    fields = [f.split()[0] for f in COLUMNS.split(", ")]
    return spark.range(n).withColumnRenamed("id", "i").select(*[v.alias(c) for v, c in zip(values, fields, strict=True)])


def test_marks_are_written_before_they_are_dealt(spark, tmp_path, monkeypatch):
    """Whole rows were dealt by their mark's key and again by the registry's number."""
    plans, saved = [], numbering.saved
    monkeypatch.setattr(numbering, "saved", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, *a, **k))
    marks = some_marks(spark)
    madrid = spark.createDataFrame([("4-1", "granted", ["VN", "VN"]), ("L", "refused", ["FR"]), ("", None, None)], "irn string, vn_status string, designated_countries array<string>")
    index = FacetIndex.build(marks, f"{tmp_path}/i", madrid)
    assert len(plans) == 1 and not re.search(r"Window|Join", plans[0])
    reps = {r.id for r in linkage.representatives(marks).collect()}
    assert {r.id for r in index.ids(FilterSpec(), representatives=True).collect()} == reps and len(reps) < 400
    status = dict(madrid.select("irn", "vn_status").collect())
    for want in ("granted", "refused"):
        found = {r.id for r in marks.collect() if status.get(r.lineage_key) == want}
        assert {r.id for r in index.ids(FilterSpec(vn_status=want)).collect()} == found and found
    # Marks that hold the flag already give the same counts.
    flagged = FacetIndex.build(linkage.with_representative(marks), f"{tmp_path}/j", madrid)
    for spec in (FilterSpec(), FilterSpec(country="VN", record_type="A"), FilterSpec(applicant="o1", vn_status="granted")):
        assert sorted(map(tuple, index.facets(spec).collect())) == sorted(map(tuple, flagged.facets(spec).collect()))


def test_shuffled_sides_of_the_index(spark, tmp_path, monkeypatch):
    marks = some_marks(spark)
    want = [sorted(map(tuple, FacetIndex.build(marks, f"{tmp_path}/i").facets(s).collect())) for s in (FilterSpec(), FilterSpec(country="VN", record_type="A"))]
    monkeypatch.setattr("markweave.storage.BROADCAST_BYTES", -1)
    index = FacetIndex.build(marks, f"{tmp_path}/j")
    plan = index.facets(FilterSpec(country="VN"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [sorted(map(tuple, index.facets(s).collect())) for s in (FilterSpec(), FilterSpec(country="VN", record_type="A"))] == want


def test_filtered_bitmaps_are_sent_once(spark, tmp_path):
    """each bitmap was doubled into two rows and dealt; six facets had six copies of what is met."""
    index = FacetIndex.build(some_marks(spark), f"{tmp_path}/i")
    out = index.facets(FilterSpec(record_type="A", nice_class=("05",)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(bits" not in plan and "bitmap_and_agg" not in plan
    met = index._met(index._clauses(FilterSpec(record_type="A", nice_class=("05",))), ["nice_class", ""])
    assert met.groupBy("own").count().count() == 2 == met.count()
    # What a limit leaves out isn't dealt to one task: Spark cuts each task's rows first.
    assert "WindowGroupLimit" in plan


def test_bitmaps_end_with_their_bucket(spark):
    """A run of 32,768 rows that begins inside a bucket gave two entries for each value and bucket."""
    i = np.arange(20_000, 20_000 + 3 * 32_768)
    batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(x % 2 == 0), pa.array(["v"] * len(x))], ["_i", "_rep", "f"]) for x in np.array_split(i, 10)]
    got = [tuple(r.values()) for b in facet_index._pieces(False)(iter(batches)) for r in b.select(["value", "bucket", "n", "rows"]).to_pylist()]
    ends = [20_000, 32_768, 65_536, 98_304, 118_304]
    assert [(v, b, n, len(r)) for v, b, n, r in got] == [("v", k + 1, (e - s) // 2, e - s) for k, (s, e) in enumerate(zip(ends, ends[1:], strict=False))]
    assert [x + (b - 1) * 32_768 for _, b, _, r in got for x in r] == i.tolist()


def test_marks_without_names_deal_lineitem_once(spark, monkeypatch):
    """Lineitem was dealt by order, customer, part and supplier where these were not small enough for Spark."""
    d = "/root/testdata/sf0.001"
    want = roles.marks(spark, d).drop("mark_sample", "mark_name", "logo_phash")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = roles.marks_unnamed(spark, d)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == 1 < roles.marks(spark, d)._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin")
        rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
        assert rows(got) == rows(want)
        # Keys far apart would be a bitmap each: they are joined.
        monkeypatch.setattr(roles, "BROADCAST_BYTES", -1)
        assert rows(roles.marks_unnamed(spark, d)) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Keys of any sign, and those that are missing.
    keys = spark.createDataFrame([(k,) for k in (-40_000, -1, 0, 1, 32_768, 32_769)], "k long")
    lines = spark.createDataFrame([(k,) for k in (None, -40_000, -39_999, -2, -1, 0, 1, 2, 32_767, 32_768, 32_769, 32_770)], "l long")
    monkeypatch.undo()
    assert sorted(r.l for r in roles._with_key_in(lines, "l", keys, "k").collect()) == [-40_000, -1, 0, 1, 32_768, 32_769]


def test_files_of_a_keyed_table_are_whole(spark, tmp_path):
    """Tasks took ranges of Spark's samples, so that each ended with a small file (tests/test_storage.py failed by it, depending on what ran before)."""
    rows = spark.range(30_000).select(F.concat(F.lit("k"), F.xxhash64("id") % 7).alias("a"), F.when(F.col("id") < 29_000, F.col("id") * 3).otherwise(-F.col("id")).alias("b"), F.lit("v").alias("v"))
    for _ in range(3):  # other samples each time
        table = KeyedTable.create(rows, f"{tmp_path}/{_}", ["a", "b"], 500)
        files = sorted((tuple(r.low), tuple(r.high), r.rows) for r in table.manifest().collect())
        assert [f[2] for f in files] == [500] * 60 and all(x[1] < y[0] for x, y in zip(files, files[1:], strict=False))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
