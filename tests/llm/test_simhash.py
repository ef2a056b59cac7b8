import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from markweave.llm import simhash
from markweave.llm.components import components
from tests.llm.brute import reach


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    bits = 0
    for b in range(64):
        if 2 * sum(xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) > len(grams):
            bits |= 1 << b
    return bits


@pytest.mark.parametrize("cap", [4096, 2])
def test_components_as_brute_force(docs, cap):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, bucket_rows=cap).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    least = reach(fps, links)
    assert got == {d: (f"{fp:016x}", least[d]) for d, fp in fps.items()}


def test_hot_buckets_split_without_losing_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, dtype=np.int64)
    fps = sorted({int(base) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 62, (400, 3))})
    edges = simhash.near_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket_rows=8)
    got = reach(fps, [(r.a, r.b) for r in edges.collect()])
    assert all((r.a ^ r.b).bit_count() <= 64 for r in edges.collect())
    assert got == reach(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])


def test_gray_rank(spark):
    rows = spark.range(256).select((F.col("id").bitwiseXOR(F.shiftright("id", 1))).alias("code"), "id")
    assert rows.select(simhash.gray_rank(F.col("code")).alias("r"), "id").where("r <> id").isEmpty()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and len(set(got.values())) == 2
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_one_stays_and_odd_tables(docs, empty, clashing):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == simhash.near_copies(docs).where("kept").count()
    assert simhash.one_of_each(clashing).columns == clashing.columns
    assert simhash.near_duplicates(empty).isEmpty()


def brute_shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_copies(texts):
    """{id: text} -> the least id that links of a Jaccard similarity of 0.8 reach."""
    sets = {d: brute_shingles(t) for d, t in texts.items()}
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    return reach(sets, [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])])


def test_near_copies_as_brute_force(docs):
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == brute_copies({r.doc_id: r.text for r in docs.collect()}) and len(set(got.values())) < len(got) - 8


def edited(rng, words, share):
    return [f"new{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("cap", [4096, 8])
def test_recall_of_near_copies(spark, cap):
    # 120 pairs with similarities around 0.8 to 0.9, and a family that no bucket holds.
    rng, texts = np.random.default_rng(5), {}
    for i in range(120):
        base = [f"w{rng.integers(5000)}" for _ in range(300)]
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(edited(rng, base, 0.01 + 0.012 * rng.random()))
    base = [f"w{rng.integers(5000)}" for _ in range(300)]
    texts |= {1000 + i: " ".join(edited(rng, base, 0.003)) for i in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(rows, bucket_rows=cap).collect()}
    want = brute_copies(texts)
    linked = [d for d, c in want.items() if c != d]
    assert len(linked) > 120 and all(got[d] == want[d] for d in got if want[d] == d)
    assert sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked)
    sure = [d for d in linked if d >= 1000]
    assert len(sure) == 59 and all(got[d] == 1000 for d in sure)


def test_chance_neighbours_take_no_copies(spark, monkeypatch):
    # Codes of 12 bits have 79 of 4,096 within two bits: 20 and more chance neighbours each.
    monkeypatch.setattr(simhash, "CODE_BITS", 12)
    rng, texts = np.random.default_rng(8), {}
    for i in range(250):
        base = [f"w{rng.integers(5000)}" for _ in range(300)]
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(edited(rng, base, 0.018 + 0.006 * rng.random()))
    for i in range(600):
        texts[1000 + i] = " ".join(f"w{rng.integers(5000)}" for _ in range(300))
    texts |= {2000 + i: " ".join(edited(rng, base, 0.003)) for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_copies(texts)
    linked = [d for d, c in want.items() if c != d]
    assert len(linked) > 150
    for cap in (4096, 8):
        got = {r.doc_id: r.component_id for r in simhash.near_copies(rows, bucket_rows=cap).collect()}
        assert all(got[d] == want[d] for d in got if want[d] == d)
        assert sum(got[d] == want[d] for d in linked) >= 0.9 * len(linked), cap


def test_least_forests_keep_every_threshold():
    rng = np.random.default_rng(9)
    a, b, apart = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 12, 400)
    kept = simhash._least_forest(60, [(a[:150], b[:150], apart[:150]), (a[150:], b[150:], apart[150:])])
    for most in range(12):
        links = lambda x: [(i, j) for i, j, d in zip(*(y.tolist() for y in x), strict=True) if d <= most]  # noqa: B023, E731
        assert reach(range(60), links((a, b, apart))) == reach(range(60), links(kept))
    assert len(kept[0]) < 60


@pytest.mark.parametrize("cap", [4096, 2])
@pytest.mark.parametrize("share", [0.001, 0.006])
def test_a_rejected_candidate_takes_no_link_with_it(spark, monkeypatch, cap, share):
    # 40 texts that are all candidates of each other, of which only a few given pairs are links;
    # with few edits most share their codes, with more their codes are only near.
    rng = np.random.default_rng(21)
    base = [f"w{rng.integers(5000)}" for _ in range(400)]
    texts = {i: " ".join([*edited(rng, base, share), f"end{i}"]) for i in range(40)}
    links = {tuple(sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(22)}
    wanted = spark.createDataFrame(sorted(links), "i long, j long")

    def verified(pairs, distinct, docs, words, similarity):
        of = lambda x: distinct.select(F.col("fp").alias(x), F.col("least").alias(f"d{x}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("da", "db").alias("i"), F.greatest("da", "db").alias("j"))
        return both.join(wanted, ["i", "j"]).select("a", "b")

    monkeypatch.setattr(simhash, "_verified", verified)
    monkeypatch.setattr(simhash, "bit_limits", lambda similarity: (-1, 64 * simhash.WIDE))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(rows, bucket_rows=cap).collect()}
    assert len(set(texts.values())) == 40 and got == reach(texts, links)


def test_classes_are_passed_over_and_no_other_pairs():
    rng = np.random.default_rng(4)
    codes = np.sort(rng.integers(0, 1 << 10, 300).astype(np.uint64) << np.uint64(54))
    starts, kind = np.array([0, 120, 121]), rng.integers(-1, 3, 300)
    kind[130:290] = 2
    pairs = lambda **more: sorted((i, j) for a, b in simhash._near_pairs(codes, starts, 2, **more) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    bucket = np.searchsorted(starts, np.arange(300), "right")
    want = [(i, j) for i in range(300) for j in range(i + 1, 300) if bucket[i] == bucket[j] and int(codes[i] ^ codes[j]).bit_count() <= 2]
    assert pairs() == want
    assert pairs(kind=kind) == [(i, j) for i, j in want if kind[i] != kind[j] or kind[i] < 0]
