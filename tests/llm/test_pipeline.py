from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from markweave.llm import mixing, packing, quality, simhash, tokens
from markweave.llm.common import saved
from tests.llm.test_lines_quality import brute_lines, brute_removed, key
from tests.llm.test_simhash import brute_copies


def test_stages_as_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, columns = docs.collect(), docs.columns
    good = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    step = corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).cache()
    gone = brute_removed(rows, quality.LINE_DOCS, quality.LINE_SHARE)
    left = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id]) for r in rows if r.doc_id in good}
    assert step.columns == columns and {r.doc_id: r.text for r in step.collect()} == left and any(gone[d] for d in good)
    kept = step.collect()
    lines = corpus_pipeline.dedup_lines(spark, step, str(tmp_path)).cache()
    held = defaultdict(set)
    for r in kept:
        for x in r.text.split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == r.doc_id) for r in kept}
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == want and brute_lines(kept)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    least = brute_copies(want)
    near = corpus_pipeline.near_dedup(spark, lines, str(tmp_path))
    stays = {d for d in want if least[d] == d}
    assert 0 < len(stays) < len(want)
    assert near.columns == columns and {r.doc_id for r in near.collect()} == stays
    mixed = corpus_pipeline.mix(spark, near, str(tmp_path))
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == stays
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    totals = defaultdict(int)
    for r in out:
        totals[r.doc_id] += r.length
    assert totals == {d: len(tokens.ids(want[d])) + 1 for d in stays}
    assert len({r.sequence_id for r in out}) <= -(-sum(totals.values()) // packing.LENGTH) + 1


@pytest.mark.parametrize("task_pieces", [None, 400])
def test_sequences_follow_the_source_weights(spark, task_pieces):
    # 20 to 5 by weight; the lighter source has the shorter texts.
    rows = [(i, "word " * (40 if i % 5 else 25), "src0" if i % 5 else "src1") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = saved(corpus_pipeline.mix(spark, docs, ""), "mixed-test")
    if task_pieces:
        got = packing.pack(saved(packing.pieces(mixed, in_order=True), "pieces-test"), task_pieces=task_pieces, in_order=True)
    else:
        got = corpus_pipeline.pack(spark, mixed, "")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ordered = sorted((r.sequence_id, r.offset, r.doc_id) for r in got.collect())
    assert [d for _, _, d in sorted((d, 0, d) for _, _, d in ordered)] == list(range(2400))
    # Runs of 400 rows: a block of 32 of the lighter source more or less, and open bins.
    for i in range(0, 2400, 400):
        assert abs(sum(d % 5 == 0 for _, _, d in ordered[i : i + 400]) - 80) <= 40
    slots = {r.doc_id: (r.mix_slot, r.mix_offset) for r in mixing.mix_sources(docs).collect()}
    place = {d: i for i, (_, d) in enumerate(sorted((s, d) for d, s in slots.items()))}
    assert all(abs(place[d] - i) <= 150 for i, (_, _, d) in enumerate(ordered))


def test_clashing_columns_and_odd_rows_stay(spark, docs):
    names = "n_lines n_dropped mix_slot mix_class _row places kept doc_key fp".split()
    odd = spark.createDataFrame([(None, "one two three\n" * 3, "en", None, 5), (None, None, None, None, None), (3, "a b c", "en", "src0", 5), (3, "a b c", "en", "src0", 5)], docs.schema)
    rows = docs.unionByName(odd).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in names}).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "").cache()
        assert out.columns == rows.columns, name
        assert out.count() > 0 and all(r[c] == c + ("" if r.doc_id is None else str(r.doc_id)) for r in out.collect() for c in names), name
        assert name in ("quality rules", "SimHash near-dedup") or out.count() == rows.count(), name


def test_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "source mixing", "best-fit packing"]
    with pytest.raises(ValueError):
        mixing.quotas({"a": 1.0}, 0.0, 1)
    assert simhash.fingerprint("") == 0
