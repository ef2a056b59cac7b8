"""Null ids, repeated rows and very long texts in every operator over documents."""

import hashlib
from collections import Counter

import pytest

from markweave.llm import common, line_dedup, mixing, packing, quality, secrets, sharding, simhash, suffix_dedup, token_scan
from tests.llm.conftest import SCHEMA, words


@pytest.fixture(scope="module")
def odd(spark):
    import random

    rng = random.Random(3)
    long = words(rng, 40_000)
    shared = "a line that two documents hold\nand an own one"
    rows = [(None, shared), (None, shared + " more"), (None, None), (1, shared), (1, shared), (2, long), (3, "w" * 300_000), (3, "w" * 300_000), (4, None), (5, long + " tail"), (6, "")]
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3).cache()


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_every_row_comes_back(odd):
    ids = rows_of(odd, "doc_id")
    made = {
        "op1": simhash.near_duplicates(odd), "near": simhash.near_copies(odd), "op2": sharding.shard_documents(odd), "op3": mixing.mix_sources(odd), "op4": line_dedup.digest(odd), "op6": secrets.report(odd),
        "op7": quality.judge(odd), "op9": token_scan.document_tokens(odd), "op10": suffix_dedup.digest(odd),
    }
    for name, df in made.items():
        assert rows_of(df, "doc_id") == ids, name
    pieces = packing.pack_documents(odd).where("piece = 0")
    assert rows_of(pieces, "doc_id") == ids


def test_components_of_null_ids(odd):
    for df in (simhash.near_duplicates(odd), simhash.near_copies(odd)):
        got = {(r.doc_id, r.component_id) for r in df.collect()}
        assert {c for d, c in got if d == 2 or d == 5} == {2} and {c for d, c in got if d == 6 or d == 4} == {4}


def test_a_null_id_holds_lines_first(odd):
    got = {(r.doc_id, r.n_dropped) for r in line_dedup.digest(odd).collect()}
    assert (None, 0) in got and (1, 2) in got and (None, 1) not in got


def test_repeats_of_odd_rows(odd):
    rows = suffix_dedup.digest(odd).collect()
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_kept, r.removed, r.kept_text) for r in rows}
    size = len(text[2].encode())
    assert got[2] == (size, size, 0, f"0:{size}", "") and got[5] == (size + 5, size, 5, f"0:{size}", " tail") and got[3][1:3] == (300_000, 0)
    assert got[1][1] == 0 and all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in rows)
    first = {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(odd, keep_first=True).collect()}
    assert (2, 0) in first and (5, size) in first


def test_repeated_rows_keep_their_places(odd):
    again = lambda: sorted(((r.mix_slot, r.mix_offset, r.doc_id or -1, r.text or "") for r in mixing.mix_sources(odd.repartition(4)).collect()))
    assert again() == again()


def test_a_code_point_goes_whole():
    text = "aé日𝒳z".encode()
    for s in range(len(text) + 1):
        for e in range(s + 1, len(text) + 1):
            out = suffix_dedup._whole_points(text, [(s, e)])
            assert set(out) <= set("aé日𝒳z") and all(c in out for c in text[:s].decode(errors="ignore") + text[e:].decode(errors="ignore"))


def test_saved_tables_are_cleared():
    """In a process of its own, as other tests read tables that they saved."""
    import subprocess
    import sys

    code = """
import pathlib, tempfile
from pyspark.sql import SparkSession
from markweave.llm import common
top = tempfile.mkdtemp()
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", top).config("spark.ui.enabled", "false").getOrCreate()
assert common.saved(spark.range(3), "x").count() == 3 and list(pathlib.Path(top).rglob("*.parquet"))
common.clear(spark)
assert not list(pathlib.Path(top).rglob("*.parquet"))
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=200).returncode == 0


def test_both_sides_of_the_broadcast_limit(docs, monkeypatch):
    make = {
        "op10": lambda: suffix_dedup.digest(docs).select("doc_id", "n_removed", "kept_sha256"),
        "near": lambda: simhash.near_copies(docs).select("doc_id", "component_id", "kept"),
        "one": lambda: simhash.one_of_each(docs).select("doc_id", "text"),
        "good": lambda: quality.keep_good(docs, line_docs=2, line_share=0.1).select("doc_id", "text"),
    }
    for name, f in make.items():
        want = Counter(map(tuple, f().collect()))
        with monkeypatch.context() as m:
            m.setattr(common, "BROADCAST_BYTES", -1)
            assert Counter(map(tuple, f().collect())) == want, name
