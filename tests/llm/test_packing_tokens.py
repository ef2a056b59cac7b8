from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from markweave.llm import packing, token_scan, tokens

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(texts):
    for t in [*filter(None, texts), "<|endoftext|> in a text", "it's x y\x1cz\x85", "кириллица ́ ẩm", "  trailing  ", "\r\n\n x", "🎉👩‍👩‍👧", "1234567 ½ ²"]:
        assert tokens.ids(t).tolist() == EXACT.encode(t, add_special_tokens=False).ids
    assert tokens.END in tokens.ids("a<|endoftext|>b") and tokens.END not in tokens.ids("a<|endoftext|>b", ordinary=True)


def test_pieces_and_places(docs):
    rows = packing.pack_documents(docs, length=256).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(text)
    for d, own in by_doc.items():
        ids = np.array([*EXACT.encode(text[d], add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 256))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 256 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == crc32(ids[r.start : r.start + r.length].tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:], strict=False)) and own[-1].offset + own[-1].length <= 256
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 256) * 1.03 + 1


def test_best_fit_against_plain_search():
    rng, fit, bins = np.random.default_rng(1), packing.BestFit(100, 8), {}
    for size in rng.integers(1, 101, 3000).tolist():
        fits = [(free, s) for s, free in bins.items() if free >= size]
        s, offset = fit.place(size)
        if fits:
            assert bins[s] == min(fits)[0]
        elif len(bins) >= 8:
            del bins[next(k for k in bins if bins[k] == min(bins.values()) and k not in [x for b in fit.bins for x in b])]
        assert offset == 100 - bins.get(s, 100)
        bins[s] = bins.get(s, 100) - size
        if not bins[s]:
            del bins[s]
        assert len(bins) == fit.open <= 8


def test_token_counts_over_any_blocks(docs, empty, clashing):
    want = {r.doc_id: len(EXACT.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    for size in (2, 10, 1 << 20):
        assert {r.doc_id: r.n_tokens for r in token_scan.document_tokens(docs, size).collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_scan.document_tokens(clashing).collect()} == want
    assert token_scan.document_tokens(empty).isEmpty() and packing.pack_documents(empty).isEmpty()
    assert packing.pack_documents(clashing).count() == packing.pack_documents(docs).count()


def test_flat_files_and_an_open_end(spark, tmp_path):
    e = tokens.END
    files = {"a.bin": [1, 2, e, e, 3, e, 4, 5], "b.bin": [e], "none.bin": [], "in/c.bin": [7] * 5000 + [e] + [8] * 3}
    (tmp_path / "in").mkdir()
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    (tmp_path / "odd.bin").write_bytes(np.array([1, e], "<u2").tobytes() + b"x")
    listed = token_scan.list_token_files(spark, str(tmp_path))
    assert listed.count() == 5
    want = [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 1, True), ("a.bin", 3, 2, False), ("b.bin", 0, 0, True), ("c.bin", 0, 5000, True), ("c.bin", 1, 3, False), ("odd.bin", 0, 1, True)]
    for block, part in ((6, 6), (6, 18), (2, 1 << 10), (1 << 20, 64 << 20)):
        got = sorted((r.file.rpartition("/")[2], r.place, r.n_tokens, r.complete) for r in token_scan.count_tokens(listed, block_bytes=block, range_bytes=part).collect())
        assert got == want, (block, part)


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    # Sparse: ends stand at two places on both sides of 2 GB.
    e, size = tokens.END, (2 << 30) + (64 << 20)
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
        for at in (1 << 30, size - 4):
            f.seek(at)
            f.write(np.array([e], "<u2").tobytes())
    counts = token_scan.count_tokens(token_scan.list_token_files(spark, str(tmp_path)), block_bytes=16 << 20)
    first = (1 << 30) // 2
    assert sorted((r.place, r.n_tokens, r.complete) for r in counts.collect()) == [(0, first, True), (1, size // 2 - 2 - first - 1, True), (2, 1, False)]


def test_files_of_lost_attempts_do_not_count(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    listed = token_scan.write_token_files(docs, str(tmp_path / "flat"))
    (tmp_path / "flat/000000-lost.bin").write_bytes(b"\0" * 50)
    counts = token_scan.count_tokens(listed.where("place < 0").select("file", "bytes"))
    assert counts.count() == 6 and len({r.n_tokens for r in counts.collect()}) == 1
