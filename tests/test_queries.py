"""Queries without SQL, over whole tables, against plain Python."""

import html
import pathlib
import re

import pytest

from markweave.functions import phonetics
from markweave.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="no test tables")


def test_page_lines(spark):
    want = []
    for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect():
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", r.html or "")
        text = re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr|td|th|li|h[1-6]|table|ul|ol|section|title)\s*>", "\n", text)
        text = html.unescape(re.sub(r"(?s)<[^>]*>", " ", text))
        lines = [" ".join(re.split(r"[ \t\n\x0b\f\r ]+", x)).strip(" ") for x in text.split("\n")]
        kept = []
        for x in lines:
            if x and (not kept or kept[-1] != x):
                kept.append(x)
        want += [(r.page_id, i, x) for i, x in enumerate(kept)]
    assert sorted(map(tuple, QUERIES["h01_page_lines"](spark, DATA).select("page_id", "line_no", "line").collect())) == sorted(want)


def test_sounds_of_all_names(spark):
    names = {r.p_name for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_name").collect()}
    codes = {r.p_name: (r.primary, r.secondary) for r in QUERIES["x03_double_metaphone"](spark, DATA).collect()}
    assert codes == {n: phonetics.double_metaphone(n) for n in names}
    keys = {r.p_name: (r.key, r.vietnamese) for r in QUERIES["x08_vn_keys"](spark, DATA).collect()}
    tokens = lambda n: phonetics.name_tokens(phonetics.fold_name(n))
    assert keys == {n: (" ".join(k for k in map(phonetics.vn_key, tokens(n)) if k), phonetics.is_vietnamese(n)) for n in names}


def test_sound_search_over_the_table(spark):
    from markweave import roles
    from markweave.operators.linkage import dedup_key

    q, rows = "cold bolt", roles.marks(spark, DATA).select("id", "mark_sample", "mark_name", "certificate_number", "vn_grant_date", dedup_key().alias("key")).collect()
    grams = lambda n: {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", n.lower()) for i in range(len(w) + 1)}
    alike = lambda n: len(grams(n) & grams(q)) / len(grams(n) | grams(q))
    code = phonetics.double_metaphone(q)[0][:4]
    found = []
    for r in rows:
        names = [n for n in (r.mark_sample, r.mark_name) if n is not None]
        if any(alike(n) >= 0.15 or phonetics.double_metaphone(n.lower())[0][:4] == code for n in names):
            found.append((-max(map(alike, names)), r.id, r, max(phonetics.phonetic_score(q, n) for n in names)))
    best = {}
    for _, _, r, score in sorted(found, key=lambda x: x[:2])[:1000]:
        rank = (r.certificate_number is not None, r.vn_grant_date is not None, r.id)
        if r.key not in best or rank > best[r.key][0]:
            best[r.key] = (rank, score)
    want = sorted(((-s, rank[2]) for rank, s in best.values() if s >= 0.4))[:50]
    assert sorted((-r.score, r.id) for r in QUERIES["x21_sound_search"](spark, DATA).collect()) == want
