from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from markweave.functions import phonetics
from markweave.operators import facets, filters, layout, linkage, quality
from markweave.operators.filters import FilterSpec
from markweave.plans import derive, search
from markweave.plans.name_postings import NameIndex
from markweave.sources import readers, sinks
from markweave.streaming import incremental

SCHEMA = "id string, gazette_id string, application_number string, certificate_number string, madrid_number string, lineage_key string, vn_grant_date date, publication_date date, mark_sample string, mark_name string, applicant_name string, ip_agency string, nice_classes array<string>, vienna_codes array<string>, record_type string"


@pytest.fixture(scope="module")
def marks(spark):
    day = date(2020, 1, 1)
    rows = [
        ("a1", "g1", "4-1", None, None, "4-1", day, day, "ALPHA", None, "Acme", "Ag", ["05"], ["26.1.1"], "A"),
        ("a2", "g2", "4-1", "C1", None, "4-1", day, None, "ALPHA", None, "Acme", "Ag", ["05"], ["26.1.1", "5.3.13"], "B_domestic"),
        ("b1", "g1", "4-2", None, None, "4-2", day, day, "BETA", None, "Acme", "Ag", ["05", "12"], ["5.7.1"], "A"),
        ("b2", "g2", "4-2", "C2", None, "4-2", day, day, "BETA", None, "Acme", "Ag", None, ["5.7.20"], "B_domestic"),
        ("c1", "g1", "", None, None, None, None, None, "GAMMA", None, "Other", "Ag", ["12"], ["15.7.1"], "A"),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_one_representative_of_each_group(marks):
    flagged = linkage.with_representative(marks)
    assert ids(flagged.where("is_representative")) == ["a2", "b2", "c1"] and ids(linkage.representatives(marks)) == ["a2", "b2", "c1"]
    assert linkage.recompute(flagged).isEmpty()
    assert facets.facet_granted(marks).first()[0] == 2 and marks.agg(F.count("vn_grant_date")).first()[0] == 4


def test_purge_lets_the_survivor_stand(marks):
    left = linkage.purge(linkage.with_representative(marks), "g2")
    assert ids(left.where("is_representative")) == ["a1", "b1", "c1"]


def test_dedup_then_filter_is_not_filter_then_dedup(marks):
    assert ids(filters.apply(linkage.representatives(marks), FilterSpec(record_type="A"))) == ["c1"]
    assert ids(search.deduped(filters.apply(marks, FilterSpec(record_type="A")))) == ["a1", "b1", "c1"]


def test_codes_are_hierarchical(marks):
    assert ids(filters.apply(marks, FilterSpec(vienna=("5.7",)))) == ["b1", "b2"]
    each = [set(ids(filters.apply(marks, FilterSpec(vienna=(c,))))) for c in ("26.1.1", "5.3.13")]
    any_of = set(ids(filters.apply(marks, FilterSpec(vienna=("26.1.1", "5.3.13"), vienna_mode="any"))))
    all_of = set(ids(filters.apply(marks, FilterSpec(vienna=("26.1.1", "5.3.13")))))
    assert any_of == each[0] | each[1] and all_of == each[0] & each[1]


def test_facets_in_one_pass_equal_single_ones(marks):
    spec = FilterSpec(nice_class=("12",))
    marks = marks.withColumn("applicant_country_code", F.lit("VN")).withColumn("mark_category", F.col("record_type"))
    every = {(r.facet, r.value): r.n for r in facets.facets_all(marks, spec).collect()}
    nice = {("nice", r.value): r.n for r in facets.facet_nice(marks, spec).collect()}
    country = {("country", r.value): r.n for r in facets.facet(marks, "applicant_country_code", "country", spec).collect()}
    assert {k: v for k, v in every.items() if k[0] == "nice"} == nice and {k: v for k, v in every.items() if k[0] == "country"} == country


def test_percent_signs_in_q_are_wildcards(marks):
    assert ids(filters.apply(marks, FilterSpec(q="a%a"))) == ["a1", "a2", "c1"]


def test_capped_score_runs_on_the_cap_only(marks):
    out = search.capped(marks, [F.asc("id")], 2)
    assert ids(out) == ["a1", "a2"] and ids(search.page(marks, [F.desc_nulls_first("publication_date"), F.asc("id")], 2)) == ["a2", "c1"]


def test_sections(spark):
    lines = ["noise", "(111) 4-0001 x", "(511) Class one", "goes on", "(540) NAME", "(511) still the name", "more", "(731) Owner", "(116) 777", "(151) 01.02.2020"]
    df = spark.createDataFrame([("d", "B", i, x) for i, x in enumerate(lines)], "doc string, kind string, line_no int, line string")
    got = {(r.section, r.code): r.value for r in layout.sections(df).collect()}
    assert got == {(1, "111"): "4-0001", (1, "511"): "Class one goes on", (1, "540"): "NAME more", (1, "731"): "Owner", (2, "116"): "777", (2, "151"): "01.02.2020"}
    maps = layout.section_maps(layout.sections(df)).collect()
    assert {r.section: r.fields.get("116") for r in maps} == {1: None, 2: "777"}


def test_layout(spark):
    words = [("d", 1, f"w{i}", x, x + 40.0, float(10 * (i % 5))) for i, x in enumerate([0.0] * 5 + [200.0] * 5)]
    w = spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double")
    assert [r.line for r in layout.word_lines(w).orderBy("line_no").collect()] == [f"w{i}" for i in range(10)]
    images = spark.createDataFrame([("d", 1, "i1", 5.0, 50.0), ("d", 1, "i2", 100.0, 200.0)], "doc string, page int, image string, top double, bottom double")
    marks_ = spark.createDataFrame([("d", 1, "L1", 90.0), ("d", 1, "L2", 150.0)], "doc string, page int, label string, y double")
    assert {(r.image, r.owner) for r in layout.label_above(images, marks_).collect()} == {("i1", "unknown"), ("i2", "L1")}
    assert sorted((r.image, r.owner, r.start, r.end) for r in layout.image_slices(images, marks_).collect()) == [("i1", "unknown", 5.0, 50.0), ("i2", "L1", 100.0, 150.0), ("i2", "L2", 150.0, 200.0)]
    rects = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 15.0, 0.0, 20.0, 10.0), ("d", 1, 100.0, 100.0, 110.0, 110.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.x0, r.x1) for r in layout.merge_rectangles(rects).collect()) == [(0.0, 20.0), (100.0, 110.0)]
    block = spark.createDataFrame([("b", 1, "see (2", 0.0), ("b", 2, "10) 4-1", 9.0)], "block string, line_no int, line string, y double")
    assert [(r.match, r.line_no) for r in layout.marker_places(block, r"\(2 ?10\)").collect()] == [("(2 10)", 1)]


def test_name_index_and_imports(spark, tmp_path):
    (tmp_path / "n.csv").write_text("﻿210 Application number,220 Application submission date,540 Trademark sample\n4-1,1/2/70,ABC\n4-2,junk,DEF\n,1/2/03,X\n4-3,1/2/03,\n", "utf-8")
    rows = {r.application_number: r.submission_date for r in readers.name_index(spark, str(tmp_path / "n.csv")).collect()}
    assert rows == {"4-1": date(1970, 1, 2), "4-2": None}
    # The last row of a number wins, in one file and over files by their names.
    (tmp_path / "d").mkdir()
    head = "210 Application number,220 Application submission date,540 Trademark sample\n"
    (tmp_path / "d/b.csv").write_text(head + "4-1,1/2/71,NEWER\n4-9,,X\n4-9,,Y\n", "utf-8")
    (tmp_path / "d/a.csv").write_text(head + "4-1,1/2/70,OLD\n4-1,1/3/70,NEW\n" + "4-5,1/2/03,S\n" * 300 + "4-5,1/2/03,LAST\n", "utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    names = readers.name_index(spark, str(tmp_path / "d"))
    assert {r.application_number: r.mark_sample for r in names.collect()} == {"4-1": "NEWER", "4-9": "Y", "4-5": "LAST"} and names.count() == 3
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    twice = spark.createDataFrame([("4-1", "A"), ("4-1", "B")], "application_number string, mark_sample string")
    marks = spark.createDataFrame([("m1", "4-1", None), ("m2", "4-1", "own"), ("m3", None, "")], "id string, application_number string, mark_sample string")
    assert sorted((r.id, r.mark_sample) for r in derive.fill_sample(marks, twice).collect()) == [("m1", "B"), ("m2", "own"), ("m3", None)]
    (tmp_path / "w.csv").write_text('Name,Q,Country,Classes\n"A, ""b""",foo,vn,"5;12"\n,x,usa,\n')
    good, bad = readers.watchlist_csv(spark, str(tmp_path / "w.csv"))
    assert [(r.name, r.country, r.nice_class) for r in good.collect()] == [('A, "b"', "VN", ["5", "12"])] and bad.count() == 1
    (tmp_path / "A_T1_2020.csv").write_text("key,sample\n4-1,ABC\n4-2,#N/A\n")
    assert [(r.kind, r.key, r["sample"]) for r in readers.per_file_pairs(spark, str(tmp_path / "A_T1_2020.csv")).collect()] == [("application", "4-1", "ABC")]
    (tmp_path / "VN1.html").write_text("<p>x</p>")
    assert readers.pages(spark, str(tmp_path / "VN1.html")).first()[:] == ("VN1", "<p>x</p>")


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, "k", F.col("o")).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_concurrency_fold(spark):
    rows = [(1, w, v) for w, v in enumerate(["probe", "probe", "ease", "block", "probe"])] + [(2, w, "block") for w in range(4)]
    got = {r.job: (r.level, r.given_up) for r in incremental.concurrency(spark.createDataFrame(rows, "job int, window long, verdict string"), ["job"]).collect()}
    assert got == {1: (2, False), 2: (1, True)}


def test_stream_ingest_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        incremental.ingest(stream, lambda batch, n: seen.append((n, batch.count())), f"{tmp_path}/cp").awaitTermination()
    assert seen == [(0, 10)]


def test_watermarked_windows_drop_late_rows(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    schema, src = "ts timestamp, event_type string", f"{tmp_path}/ev"
    q = None
    for i, batch in enumerate([[(at(1, 0), "a"), (at(1, 30), "a")], [(at(5, 0), "a")], [(at(1, 10), "a"), (at(9, 0), "a")], [(at(9, 1), "a")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        if q is None:
            q = incremental.tumbling_counts(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
    q.stop()
    assert {(r.start.hour, r.n) for r in spark.table("tumbled").collect()} >= {(1, 2), (5, 1)}


def test_audit_reports(spark, marks):
    rows = marks.withColumns({"applicant_country_code": F.lit("VN"), "applicant_city": F.lit(None).cast("string"), "logo_path": F.lit(None).cast("string"), "registration_date": F.lit(None).cast("date"), "nice_group_number": F.array_join("nice_classes", ","), "year": F.lit(2020), "month": F.lit(1), "applicant_name": F.when(F.col("id") == "a1", "1529250 (DE)").otherwise("Acme")})
    got = {r.check: (r.suspects, r.regression, r.examples) for r in quality.audit(rows).collect()}
    assert got["Q01"] == (1, False, ["a1"]) and got["Q03"][0] == 5 and got["Q05"] == (2, None, ["a2", "b2"]) and got["Q07"][0] == 0 and got["Q10"][0] == 0
    assert quality.groups_without_representative(linkage.with_representative(rows)).isEmpty()


def test_numbered_rows_and_percentiles(spark):
    from markweave.operators.numbering import numbered

    values = [None, None, *[i * 7919 % 1009 for i in range(500)], 3, 3]
    rows = spark.createDataFrame([(v, f"g{i % 3}" if i % 5 else None) for i, v in enumerate(values)], "v int, g string")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r["_i"], r.v) for r in numbered(rows, ["v"]).collect())
        assert [i for i, _ in got] == list(range(len(values))) and [v for _, v in got] == sorted(values, key=lambda v: (v is not None, v or 0))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert numbered(rows.limit(0), ["v"]).isEmpty()
    out = {r.g: (r.low, r.high) for r in facets.percentile_at(rows, ["g"], "v", {"low": 0.5, "high": 1.0}).collect()}
    by = {}
    for r in rows.collect():
        if r.v is not None:
            by.setdefault(r.g, []).append(r.v)
    assert out == {g: (sorted(x)[min(len(x) - 1, len(x) // 2)], max(x)) for g, x in by.items()}
    assert facets.percentile_at(rows, [], "v", {"p": 0.0}).first().p == min(v for v in values if v is not None)


def test_facet_cache():
    from markweave.streaming.incremental import FacetCache

    now, calls = [0.0], []

    class Counts:
        def collect(self):
            calls.append(1)
            return [len(calls)]

    cache = FacetCache(ttl=120.0, most=2, clock=lambda: now[0])
    ask = lambda name, limit=8, **f: cache.get(name, limit, f, Counts)
    assert ask("a", country="VN", year=None) == [1] and ask("a", country="VN") == [1] and ask("a", limit=9, country="VN") == [2]
    now[0] = 119.0
    assert ask("a", country="VN") == [1]
    now[0] = 120.0
    assert ask("a", country="VN") == [3]  # two are held, so all went
    assert len(cache.held) == 1


def test_ingest_is_repeatable(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1"), ("e", "1")], "gazette_id string, sha256 string")
    held = spark.createDataFrame([("a", "1", "completed"), ("b", "1", "processing"), ("c", "1", "completed"), ("d", "1", "failed")], "gazette_id string, sha256 string, status string")
    plan = incremental.ingest_plan(files, held).cache()
    assert {r.gazette_id: r.action for r in plan.collect()} == {"a": "skip", "b": "retry", "c": "replace", "d": "retry", "e": "new"}
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), (None, 1)], "gazette_id string, n int")
    assert {r.gazette_id for r in incremental.purge_partial(rows, plan).collect()} == {"a", None}
    step = lambda e: {r.gazette_id: r.status for r in incremental.ingest_step(held, e).collect()}
    assert step("start") == {"a": "completed", "b": "processing", "c": "completed", "d": "processing"} and step("done")["b"] == "completed" and step("error")["b"] == "failed"


def sound_marks(spark):
    from datetime import date

    names = ["Cold Bolt", "kold bolt", "COLD-BOLT", "warm nut", "Coldbolt", "colt bold", "Nguyen Kim", "Nguyễn Kim", None, "", "123", "bolt", "x cold bolts y"]
    rows = []
    for i, a in enumerate(names):
        for j, b in enumerate((None, a, "cold volt", "other")):
            n = 4 * i + j
            rows.append((f"m{n:03d}", f"4-{n // 2}", None, None, f"4-{n // 2}", a if j % 2 == 0 else None, b, date(2020, 1 + n % 9, 1) if n % 7 else None, ["05", "09"] if n % 3 else ["12"], ["5.7.1"], None, None, None, None, None))
    return rows, spark.createDataFrame(rows, "id string, application_number string, certificate_number string, madrid_number string, lineage_key string, mark_sample string, mark_name string, publication_date date, nice_classes array<string>, vienna_codes array<string>, logo_phash string, logo_kind string, mark_embedding array<float>, vn_grant_date date, record_type string").cache()


def brute_trigrams(text):
    import re

    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


def brute_recall(rows, q):
    """[(similarity, id)] of the rows that J13 recalls, by plain Python."""
    out, g = [], brute_trigrams(q)
    code = phonetics.double_metaphone(q.lower())[0][:4]
    alike = lambda n: len(brute_trigrams(n) & g) / len(brute_trigrams(n) | g) if brute_trigrams(n) and g else 0.0
    for r in rows:
        names = [n for n in (r[5], r[6]) if n is not None]
        if any(alike(n) >= 0.15 or phonetics.double_metaphone(n.lower())[0][:4] == code for n in names):
            out.append((max(map(alike, names)), r[0]))
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("q", ["cold bolt", "Nguyễn", "123", "zzz"])
def test_sound_search_as_brute_force(spark, tmp_path, q):
    rows, marks = sound_marks(spark)
    by_id = {r[0]: r for r in rows}
    found = [by_id[i] for _, i in brute_recall(rows, q)]
    assert sorted((round(t, 9), i) for t, i in brute_recall(rows, q)) == sorted((round(r["_t"], 9), r.id) for r in search.recall_names(marks, q).collect())
    best = {}
    for r in found:
        best[r[1]] = max(best.get(r[1], ""), r[0])
    want = {}
    for i in best.values():
        score = max(phonetics.phonetic_score(q, n) for n in (by_id[i][5], by_id[i][6]) if n is not None)
        if score >= 0.4:
            want[i] = score
    assert {r.id: r.score for r in search.search_sound(marks, q).collect()} == want
    index = NameIndex.build(search.names_of(marks), str(tmp_path / f"names-{len(q)}"))
    assert {r.id: r.score for r in search.search_sound(marks, q, index=index).collect()} == want


def test_similar_marks_as_brute_force(spark):
    rows, marks = sound_marks(spark)
    by_id = {r[0]: r for r in rows}
    word = lambda r: (r[6] or r[5] or "").strip()
    near = lambda a, b: a[7] is None or (b[7] is not None and abs((a[7] - b[7]).days) <= 60)
    for anchor in ("m001", "m002", "m028", "m007", "m032"):
        a = by_id[anchor]
        pool = [r for r in rows if r[0] != anchor and near(a, r)]
        if word(a):
            ranked = [by_id[i] for _, i in brute_recall(pool, word(a))][:50]
        else:
            ranked = sorted([r for r in pool if r[5] is not None and (not a[8] or set(r[8]) & set(a[8]))], key=lambda r: (r[7] is not None, -(r[7].toordinal() if r[7] else 0), r[0]))[:40]
        pairs = spark.createDataFrame([(i, r[0], word(a), word(r), a[8], r[8]) for i, r in enumerate(ranked)], "n int, b_id string, a_mark_sample string, b_mark_sample string, a_nice_classes array<string>, b_nice_classes array<string>")
        none = {f"{p}_{c}": F.lit(None).cast(t) for p in "ab" for c, t in (("logo_phash", "string"), ("logo_kind", "string"), ("mark_embedding", "array<float>"))}
        full = pairs.withColumns(none | {"a_vienna_codes": F.array(F.lit("5.7.1")), "b_vienna_codes": F.array(F.lit("5.7.1"))})
        scored = [(-r.scores.result.score, r.n, r.b_id) for r in search.scored_pairs(full).collect() if r.scores.result.verdict != "Low risk"]
        want = [i for _, _, i in sorted(scored)][:4]
        assert [r.b_id for r in search.similar_marks(marks, anchor).collect()] == want, anchor
    assert search.similar_marks(marks, "nobody").isEmpty()


def many_marks(spark, n=3000):
    import random

    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = []
    for i in range(n):
        app = pick(None, "", f"4-{rng.randrange(n // 2)}")
        rows.append((f"m{i:06d}", pick("g1", "g2", "g3", None), app, pick(None, f"C{i}"), None, pick(None, f"L{i % 50}"), pick(None, date(2020, 1, 1 + i % 28)), pick("VN", "US", "FR", None), sorted({pick("05", "12", "30") for _ in range(i % 3)}) or None, [pick("5.7.1", "5.7.20", "5.3.13", "26.1.1") for _ in range(i % 4)] or None, pick("A", "B_domestic"), pick("domestic_application", "unknown"), pick("Company", None), f"Owner {rng.randrange(40)}", pick("Agent x", "agent Y", None), pick(2019, 2020), pick(1, 2)))
    schema = "id string, gazette_id string, application_number string, certificate_number string, madrid_number string, lineage_key string, vn_grant_date date, applicant_country_code string, nice_classes array<string>, vienna_codes array<string>, record_type string, mark_category string, applicant_type string, applicant_name string, ip_agency string, year int, month int"
    madrid = spark.createDataFrame([(f"L{i}", pick("granted", "refused", None), ["VN", "FR"][: i % 3]) for i in range(45)], "irn string, vn_status string, designated_countries array<string>")
    return spark.createDataFrame(rows, schema).withColumns({"mark_sample": F.lit(None).cast("string"), "mark_name": F.lit(None).cast("string")}).cache(), madrid


SPECS = [
    FilterSpec(), FilterSpec(country="vn"), FilterSpec(nice_class=("05", "12")), FilterSpec(nice_class=("05", "12"), nice_mode="any", record_type="A"), FilterSpec(vienna=("5.7", "26.1.1")), FilterSpec(vienna=("5.7.1", "5.3"), vienna_mode="any", year=2020, month=2),
    FilterSpec(applicant="owner 1", granted=True), FilterSpec(ip_agency="AGENT", mark_category="unknown", applicant_type="Company"), FilterSpec(gazette_id="g2", country="US"), FilterSpec(designated_country="fr", vn_status="granted"), FilterSpec(country="XX"), FilterSpec(vienna=("5.07.01",), country="FR"),
]


def test_bitmaps_as_scans(spark, tmp_path):
    from markweave.operators.facet_index import FacetIndex

    marks, madrid = many_marks(spark)
    index = FacetIndex.build(marks, str(tmp_path / "facets"), madrid)
    for spec in SPECS:
        assert ids(index.ids(spec)) == ids(filters.apply(marks, spec, madrid)), spec
        reps = linkage.representatives(marks)
        assert ids(index.ids(spec, representatives=True)) == ids(filters.apply(reps, spec, madrid)), spec
        if spec.vn_status is None:
            want = {tuple(r) for r in facets.facets_all(marks, spec).collect() if r.n}
            assert {tuple(r) for r in index.facets(spec).collect()} == want, spec
        one = facets.facet(marks, "applicant_country_code", "country", spec, 20, madrid)
        assert [tuple(r) for r in index.facet("country", spec).collect()] == [tuple(r) for r in one.collect()], spec
    with pytest.raises(ValueError):
        index.ids(FilterSpec(q="x"))
    # A second build takes the place of the first.
    again = FacetIndex.build(marks.where("year = 2020"), str(tmp_path / "facets"))
    assert ids(again.ids(FilterSpec(country="VN"))) == ids(marks.where("year = 2020 AND applicant_country_code = 'VN'")) and len(again.gens.clean()) == 1
    assert again.ids(FilterSpec(year=2020)).count() == marks.where("year = 2020").count()
