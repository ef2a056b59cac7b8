import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from markweave.llm import suffix_dedup as S

L = 60


def brute(rows, length, keep_first=False):
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows]
    counts = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    first = {}
    for d, t in sorted(texts):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], (d, i))
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if counts[w] > 1 and not (keep_first and first[w] == (d, i)):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "né", "x"]) + str(rng.randrange(30))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(3)]
    out = [text(40) for _ in range(6)]
    out += [text(5) + shared[i % 3] + text(5) for i in range(9)] + [shared[0][:100] + "|" + shared[0][30:], "ab" * 100, "z" * 150, "q" * 59, None, "", out[0], out[0], text(3)]
    return spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [20_000, 1])
def test_passages_as_brute_force(passages, keep_first, hot, monkeypatch):
    monkeypatch.setattr(S, "GRAM", 16)
    rows = S.remove_repeats(passages, L, keep_first, hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert got == brute(passages.collect(), L, keep_first)


def test_contract_length(docs, clashing, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(docs).collect()}
    assert got == brute(docs.collect(), 400)
    assert {r.doc_id: r.n_removed for r in S.digest(clashing).collect()} == {d: x[1] for d, x in got.items()}
    assert S.digest(empty).isEmpty()


def test_segments_of_a_long_text(monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 1000)
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 5000).astype(np.uint8).tobytes()
    starts = [(n, s + k) for number, s0, count, _, _ in S._runs([b"short", text], 400) for n, s, c in zip(number, s0, count, strict=True) for k in range(c)]
    assert sorted(starts) == [(1, i) for i in range(4601)]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [20_000, 1])
def test_a_repeat_across_segments_of_one_text(spark, keep_first, hot, monkeypatch):
    monkeypatch.setattr(S, "GRAM", 16)
    monkeypatch.setattr(S, "SEGMENT", 300)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, over = noise(90), noise(90)
    long = noise(100) + passage + noise(90) + over + noise(700) + passage + noise(130) + over + noise(50)
    texts = [noise(500), long, noise(40), noise(1000), long[:150] + noise(60)]
    alone = spark.createDataFrame(list(enumerate(texts[:4])), "doc_id long, text string")
    copies = spark.createDataFrame(list(enumerate([*texts, texts[3], texts[3]])), "doc_id long, text string")
    for rows in (alone, copies):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.remove_repeats(rows, L, keep_first, hot).collect()}
        want = brute(rows.collect(), L, keep_first)
        assert got == want and want[1][1] >= 180


def test_equal_windows_have_equal_hashes():
    data = np.frombuffer(b"abcabcabcabc", np.uint8)
    h = S.window_hashes(data, 3)
    assert h[0] == h[3] == h[6] and h[1] == h[4] and len(set(h.tolist())) == 3 and not len(S.window_hashes(data[:2], 3))
