import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from markweave.llm import mixing, sharding


def test_shards_hold_the_law(docs):
    rows = sharding.shard_documents(docs).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(rows) == len(text) and all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == crc32(text[r.doc_id]) for r in rows)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_shards_are_stable_and_move_little(spark):
    rows = spark.range(20_000).toDF("k")
    a = {r.k: r["shard"] for r in sharding.shard_rows(rows, 16).collect()}
    assert a == {r.k: r["shard"] for r in sharding.shard_rows(rows.repartition(7), 16).collect()}
    b = {r.k: r["shard"] for r in sharding.shard_rows(rows, 17).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.15 * len(a)
    more = {r.k: r["shard"] for r in sharding.shard_rows(spark.range(20_001).toDF("k"), 16).collect()}
    assert sum(a[k] != more[k] for k in a) < 0.01 * len(a)


def brute_ring(rows, nodes, shards):
    """{row: (shard, slot, hops)}: each row goes clockwise from its cell to a node, past those of
    full shards, in rounds; rows are (cell, order, row), nodes {cell: shards}."""
    room = {s: len(rows) // shards + (s < len(rows) % shards) for s in range(shards)}
    used, out, left, hops = dict.fromkeys(room, 0), {}, sorted(rows), 0
    while left:
        opened = {s for s in room if used[s] < room[s]}
        at = sorted((c, min(s & opened)) for c, s in nodes.items() if s & opened)
        over = []
        for cell, order, row in left:
            shard = next((s for c, s in at if c >= cell), at[0][1])
            if used[shard] < room[shard]:
                out[row] = (shard, used[shard], hops)
                used[shard] += 1
            else:
                over.append((cell, order, row))
        left, hops = over, hops + 1
    return out


def test_shards_as_brute_force(spark, docs):
    cells = 1 << 14
    rows = sharding.shard_documents(docs).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    inputs = spark.createDataFrame([(d, len(t) + 1, crc32(t)) for d, t in text.items()], "doc_id long, size long, text_crc32 long")
    hashed = inputs.selectExpr("doc_id", "xxhash64(doc_id, size, text_crc32) AS h").collect()
    nodes = defaultdict(set)
    for r in spark.range(16 * 64).selectExpr("CAST(id % 16 AS INT) AS s", f"pmod(xxhash64('node', CAST(id % 16 AS INT), FLOOR(id / 16)), {cells}) AS c").collect():
        nodes[r.c].add(r.s)
    want = brute_ring([(r.h % cells, r.h, r.doc_id) for r in hashed], nodes, 16)
    assert {r.doc_id: (r["shard"], r["slot"], r["hops"]) for r in rows} == want


def test_a_row_that_repeats_is_expanded_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = spark.range(500).selectExpr("1 AS k").unionByName(spark.range(30).selectExpr("CAST(id AS INT) AS k"))
    got = sharding.shard_rows(rows, 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 530 and all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(r.k == 1 for r in got) == 501


def test_repeated_rows_spread_over_shards(spark):
    rows = spark.range(1000).selectExpr("1 AS k").unionByName(spark.range(10).selectExpr("CAST(id AS INT) AS k"))
    counts = Counter(r["shard"] for r in sharding.shard_rows(rows, 4).collect())
    assert sum(counts.values()) == 1010 and max(counts.values()) - min(counts.values()) <= 1


def test_few_rows_no_rows_and_clashes(spark, empty, clashing, docs):
    assert sharding.shard_documents(empty).isEmpty()
    assert sorted(r.slot for r in sharding.shard_rows(spark.range(3).toDF("k"), 16).collect()) == [0, 0, 0]
    assert sharding.shard_documents(clashing).count() == docs.count()


@pytest.mark.parametrize("weights,rest", [({"a": 5.0, "b": 3.0, "c": 1.0}, 1.0), ({"a": 0.01}, 100.0), ({f"s{i}": 1.0 for i in range(30)}, 0.5)])
def test_deviation_is_under_a_block(spark, weights, rest):
    q = [n for _, n in mixing.quotas(weights, rest, 100)]
    plan = {r.slot: r["class"] for r in mixing.period_schedule(spark, q, 100).collect()}
    assert sum(q) == 100 and sorted(plan) == list(range(100))
    for c, n in enumerate(q):
        done = 0
        for t in range(100):
            done += plan[t] == c
            assert abs(done - (t + 1) * n / 100) < 1


def test_mixed_rows_are_whole_and_ordered(docs, empty, clashing):
    weights = {"src0": 2.0, "src1": 1.0}
    rows = mixing.mix_sources(docs, weights, rest=1.0, period=4, block=2).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    spots = [(r.mix_slot, r.mix_offset) for r in rows]
    assert len(set(spots)) == len(spots)
    by_slot = defaultdict(set)
    for r in rows:
        by_slot[r.mix_slot].add(r.mix_class)
        assert r.mix_class == {"src0": 0, "src1": 1}.get(r.source, 2)
    assert all(len(c) == 1 for c in by_slot.values())
    assert mixing.mix_sources(empty).isEmpty()
    out = mixing.mix_sources(clashing)
    assert out.count() == docs.count() and sorted(out.columns) == sorted({*clashing.columns, "mix_block", "mix_offset"})
    assert mixing.mixed_order(clashing).columns == clashing.columns
    laid = mixing.mixed_order(docs, weights=weights, rest=1.0, period=4, block=2)
    assert laid.columns == docs.columns and laid.count() == docs.count()


@pytest.mark.parametrize("sized", [False, True])
def test_shares_hold_to_the_end_with_epochs(spark, sized):
    rng, weights, block = random.Random(4), {"a": 5.0, "b": 3.0, "c": 1.0}, 20
    rows = [(i, rng.choice("aabbbbbbbcz"), rng.randrange(1, 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, weight int")
    got = mixing.mix_sources(docs, weights, rest=1.0, period=10, block=block, epochs=2, size=F.col("weight") if sized else None).collect()
    size = lambda r: r.weight if sized else 1
    places = sorted(got, key=lambda r: (r.mix_slot, r.mix_offset))
    seen, target = Counter(), {0: 0.5, 1: 0.3, 2: 0.1, 3: 0.1}
    slots = defaultdict(Counter)
    for r in places:
        slots[r.mix_slot][r.mix_class] += size(r)
    for n, slot in enumerate(sorted(slots), 1):
        seen.update(slots[slot])
        for c, share in target.items():
            assert abs(seen[c] - share * n * block) < block + 9  # a block, and a row that reaches over its end
    assert sorted(slots) == list(range(len(slots)))
    # Some source is used up twice and none starts its third round before that.
    whole, per = Counter(r.mix_class for r in mixing.mix_sources(docs, weights, rest=1.0, period=10, block=block).collect()), Counter((r.mix_class, r.mix_epoch) for r in got)
    assert any(per[c, 1] == whole[c] for c in target)
    for c in target:
        epochs = sorted(e for k, e in per if k == c)
        assert epochs == list(range(len(epochs))) and all(per[c, e] == whole[c] for e in epochs[:-1])


def test_rows_without_ids_share_no_cell(spark):
    docs = spark.range(4000).selectExpr("CAST(null AS LONG) AS doc_id", "'a' AS source", "CAST(id AS STRING) AS text")
    once, again = (sorted((r.mix_slot, r.mix_offset, r.text) for r in mixing.mix_sources(x, {"a": 1.0}).collect()) for x in (docs, docs.repartition(7)))
    assert once == again and len({x[:2] for x in once}) == 4000
    assert [x[2] for x in once] != sorted(x[2] for x in once)


def test_epochs_of_nothing(spark, empty):
    out = mixing.mix_sources(empty, epochs=3)
    assert out.isEmpty() and "mix_epoch" in out.columns
