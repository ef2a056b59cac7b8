import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from markweave.llm import line_dedup, quality

WHITE = " \t\n\v\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute_lines(rows):
    held = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(r.doc_id)
    out = {}
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == r.doc_id]
        out[r.doc_id] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches,shard_keys", [(1, 250_000), (3, 10)])
def test_lines_as_brute_force(docs, clashing, batches, shard_keys):
    want = brute_lines(docs.collect())
    for rows in (docs, clashing):
        got = line_dedup.digest(rows, batches=batches, shard_keys=shard_keys)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()} == want


def test_extra_columns_stay(clashing, empty):
    out = line_dedup.dedup_lines(clashing)
    assert set(out.columns) == set(clashing.columns) and out.count() == clashing.count()
    assert line_dedup.dedup_lines(empty).isEmpty()


def test_insert_then_delete_is_reversible(spark, docs):
    index = line_dedup.LineIndex(spark, 3)
    index.insert(docs.where("doc_id % 2 = 0"))
    before = {bytes(r.key): (r.n_docs, r.first_doc) for r in index.shared().collect()}
    marks = index.filters.select(F.sum(F.octet_length("marks"))).first()[0]
    index.insert(docs.where("doc_id % 2 = 1"))
    assert {bytes(r.key): r.n_docs for r in index.shared().collect()} != {k: n for k, (n, _) in before.items()}
    index.delete(docs.where("doc_id % 2 = 1"))
    assert {bytes(r.key): (r.n_docs, r.first_doc) for r in index.shared().collect()} == before and marks
    live = {bytes(r.key) for r in index.refs.collect()}
    held = defaultdict(list)
    for r in index.filters.collect():
        held[r.shard].append(line_dedup.CuckooFilter(r.bits, r.marks))
    assert sum(int(np.count_nonzero(f.table)) for fs in held.values() for f in fs) == len(live)


def test_an_index_outlives_its_session(spark, docs, tmp_path):
    path, state = str(tmp_path / "lines"), lambda x: {bytes(r.key): (r.n_docs, r.first_doc) for r in x.shared().collect()}
    index = line_dedup.LineIndex(spark, 3)
    for i in range(3):
        index.insert(docs.where(f"doc_id % 4 = {i}"))
    before = state(index)
    index.save(path)
    assert state(index) == before
    again = line_dedup.LineIndex.open(spark.newSession(), path)
    assert (again.shards, again.min_chars) == (3, 10) and state(again) == before
    keys = again.tallies.count()
    assert keys == again.tallies.select("key").distinct().count()  # one row a key now
    again.insert(docs.where("doc_id % 4 = 3"))
    whole = line_dedup.LineIndex(spark, 5)
    whole.insert(docs)
    assert state(again) == state(whole) != before
    again.delete(docs.where("doc_id % 4 = 3"))
    assert state(again) == before == state(line_dedup.LineIndex.open(spark, path))
    # A writer that dies before its entry is in place leaves the former state.
    lost = line_dedup.Generations(spark, path)
    lost.write(lost.begin(), "refs", whole.refs)
    assert state(line_dedup.LineIndex.open(spark, path)) == before
    whole.save(path)
    assert state(line_dedup.LineIndex.open(spark, path)) == state(whole)
    with pytest.raises(ValueError, match="no line index"):
        line_dedup.LineIndex.open(spark, str(tmp_path / "none"))


def test_held_and_unknown_ids_and_more_shards(spark, docs):
    state = lambda x: {bytes(r.key): (r.n_docs, r.first_doc) for r in x.shared().collect()}
    index = line_dedup.LineIndex(spark, 2)
    index.insert(docs)
    before, n = state(index), index.refs.count()
    index.insert(docs.where("doc_id % 3 = 0"))
    assert state(index) == before and index.refs.count() == n
    index.delete(spark.createDataFrame([(-5,), (10**9,)], "doc_id long"))
    assert state(index) == before and index.refs.count() == n
    keys = index.tallies.count()
    index.compact(shard_keys=keys // 7)
    assert index.shards == -(-keys // (keys // 7)) and state(index) == before
    assert {r.shard for r in index.filters.select("shard").collect()} == set(range(index.shards))
    index.compact()
    assert state(index) == before and index.refs.count() == n


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(1, 1 << 62, 20_000).astype(np.uint64))
    f = line_dedup.CuckooFilter.for_keys(len(keys))
    assert not f.insert(keys).any() and f.contains(keys).all()
    assert f.contains(rng.integers(1, 1 << 62, 20_000).astype(np.uint64)).mean() < 0.002
    assert f.delete(keys[:5000]).all() and f.contains(keys[5000:]).all() and f.contains(keys[:5000]).mean() < 0.01
    full = line_dedup.CuckooFilter(4)
    held = full.table.copy()
    assert full.insert(keys[:200]).all() and (full.table == held).all()


def test_deleting_a_false_hit_leaves_the_other_key():
    shard = (pa.scalar(0, pa.int32()),)
    a, b = ((n << 60 | 3 << 16 | 77).to_bytes(8, "little") + bytes(8) for n in (1, 2))  # one mark, one bucket
    none = pa.table({c: [] for c in line_dedup.OUT.names}, line_dedup.OUT)
    one = line_dedup._insert(shard, pa.table({"key": [a], "n": [1]}), none)
    two = line_dedup._insert(shard, pa.table({"key": [b], "n": [1]}), one)
    assert b in two["key"].to_pylist()
    state = two.filter(pa.compute.is_null(two["key"]))
    left = line_dedup._delete(shard, pa.table({"key": [a, b], "gone": [False, True]}), state)
    again = line_dedup._insert(shard, pa.table({"key": [a], "n": [1]}), left)
    assert a in again["key"].to_pylist()


def brute_counts(text):
    t = text or ""
    w = [x for x in "".join(" " if c in WHITE else c for c in t).split(" ") if x]
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if x.strip(WHITE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def line_of(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x if c not in WHITE)


def brute_removed(rows, least, share):
    """The numbers of the lines that each document loses."""
    held, hosts = defaultdict(set), defaultdict(set)
    for r in rows:
        hosts[r.source].add(r.doc_id)
        for x in (r.text or "").split("\n"):
            if line_of(x):
                held[r.source, line_of(x)].add(r.doc_id)
    above = {k: min(v) for k, v in held.items() if len(v) > max(least, share * len(hosts[k[0]]))}
    return {r.doc_id: [i for i, x in enumerate((r.text or "").split("\n")) if above.get((r.source, line_of(x)), r.doc_id) != r.doc_id] for r in rows}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_quality_as_brute_force(docs, clashing, broadcast, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
    rows = docs.collect()
    gone = brute_removed(rows, 2, 0.1)
    got = {r.doc_id: r for r in quality.judge(docs, line_docs=2, line_share=0.1).collect()}
    want = {}
    for r in rows:
        n, chars, symbols, dups, repeats = brute_counts(r.text)
        o, lines = got[r.doc_id], (r.text or "").split("\n")
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == (n, chars, symbols, dups, repeats)
        lost = sum(len(line_of(lines[i])) for i in gone[r.doc_id])
        failed = n < 20 or 100 * repeats > 30 * n
        assert (o.base_failed, o.n_removed_chars, o.kept, sorted(o.places or [])) == (failed, lost, not failed and chars - lost >= 0.3 * chars, gone[r.doc_id])
        if o.kept:
            want[r.doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone[r.doc_id])
    assert any(gone[d] for d in want)
    assert {r.doc_id: r.text for r in quality.keep_good(docs, line_docs=2, line_share=0.1).collect()} == want
    assert quality.judge(clashing, line_docs=2, line_share=0.1).count() == len(rows)
    good = quality.keep_good(clashing, line_docs=2, line_share=0.1)
    assert good.columns == clashing.columns and {r.doc_id: r.text for r in good.collect()} == want


def test_one_of_a_family_stays_whole(spark):
    body = "\n".join(" ".join(f"word{i}{c}" for c in "abcdefgh") for i in range(20))
    rows = [(i, body + f"\nan own line {i}", "one") for i in range(30)] + [(None, body, "one"), (None, body + " more", "one"), (99, None, None)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept = [r.doc_id for r in got if r.kept]
    assert len(got) == 33 and kept == [None] and sum(r.n_removed_chars == 0 for r in got) == 2


def test_quality_of_repeated_rows_and_none(docs, empty):
    twice = docs.unionByName(docs)
    one = {r.doc_id: r.kept for r in quality.judge(docs, line_docs=2, line_share=0.1).collect()}
    two = quality.judge(twice, line_docs=2, line_share=0.1).collect()
    assert len(two) == 2 * len(one) and all(one[r.doc_id] == r.kept for r in two)
    assert quality.judge(empty).isEmpty() and quality.keep_good(empty).isEmpty()
