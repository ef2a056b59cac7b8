import hashlib
import re

import pytest

from markweave.llm import secrets

PATTERNS = [
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
TEXTS = [
    None, "", "nothing here", "PassWord = 'abcdefgh1'", "é𝒳 secret:token:abcdefgh passwd=short token=longenough99", "AKIA" + "Z9" * 8 + " AKIAX", "0123456789abcdef" * 2 + "g" + "f" * 31,
    "api_key: " + "a1" * 20 + "\napikey=" + "b" * 8, "key ghp_" + "A1b2" * 10 + " xoxb-1234567890-x sk_live_" + "q" * 20, "-----BEGIN RSA PRIVATE KEY-----\nxx", "eyJabcdefgh1.eyJabcdefgh2.sig_natur3",
    "AIza" + "x" * 35, "token==abcdefgh", "x" * 50_000 + " secret=\"tail.value\"",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i % 12, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_spans_as_brute_force(rows, clashing, docs):
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.report(rows).collect()}
    want = set()
    for i, t in enumerate(TEXTS):
        spans = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(PATTERNS) for m in p.finditer(t or "") if good(m)]
        said = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(spans))
        want.add((i % 12, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    assert got == want
    assert secrets.report(clashing).count() == docs.count()


def test_added_kinds(rows):
    kinds = {k.split(":")[0] for r in secrets.report(rows).collect() for k in r.spans.split(",") if k}
    assert kinds == {r.kind for r in secrets.RULES}


def test_queries_hold_for_every_match():
    for r in secrets.RULES:
        query = secrets.trigram_query(r.regex)
        assert (query is None) == (r.kind == "hex")
        for t in filter(None, TEXTS):
            for m in re.finditer(r.regex, t, re.ASCII):
                low = m[0].lower()
                assert query is None or any(all(g in low for g in c) for c in query)


def test_a_rule_is_added_to_an_index(rows):
    more = (secrets.Rule("mail", r"[a-z0-9]+@example\.com"), secrets.Rule("note", r"nothing (here|there)"))
    known = secrets.build_index(rows)
    grown = secrets.extend_index(known, rows, secrets.RULES, more).cache()
    assert grown.count() > known.count() and grown.count() == secrets.build_index(rows, secrets.RULES + more).count()
    saved_postings = secrets.scan(rows, secrets.RULES + more, grown).collect()
    fresh = secrets.scan(rows, secrets.RULES + more).collect()
    key = lambda r: (r.doc_id, r.text, str(r.spans))
    assert sorted(map(key, saved_postings)) == sorted(map(key, fresh))
    assert [[s.kind - len(secrets.RULES) for s in r.spans if s.kind >= len(secrets.RULES)] for r in saved_postings if r.text == "nothing here"] == [[1]]


@pytest.mark.parametrize("per_clause", [1, 2, 3])
def test_index_queries_hold_for_every_match(per_clause):
    for r in secrets.RULES:
        query = secrets.index_query(r.regex, per_clause)
        assert query is None or all(len(c) <= per_clause for c in query)
        for m in (m for t in filter(None, TEXTS) for m in re.finditer(r.regex, t, re.ASCII)):
            assert query is None or any(all(g in m[0].lower() for g in c) for c in query)


def test_candidates_on_both_sides_of_the_broadcast(rows, monkeypatch):
    want = sorted(map(str, secrets.report(rows).collect()))
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    assert sorted(map(str, secrets.report(rows).collect())) == want


def test_no_rows(empty):
    assert secrets.report(empty).isEmpty()


def test_an_index_of_texts_answers_rules_that_come_later(spark, rows, docs, tmp_path):
    index = secrets.TextIndex(spark, str(tmp_path / "index"), buckets=8)
    index.add(rows)
    n = index.tables.read("postings", index.POSTINGS).count()
    index.add(rows.where("doc_id < 6").unionByName(docs.select("doc_id", "text")))
    texts = [r.text for r in rows.unionByName(rows.where("doc_id < 6")).unionByName(docs.select("doc_id", "text")).collect()]
    held = index.tables.read("texts", index.TEXTS).collect()
    assert sorted(r.text for r in held) == sorted({t for t in texts if t})  # each text once
    grams = sum(len({t.lower()[i : i + 3] for i in range(len(t) - 2)}) for t in {t for t in texts if t and ord(max(t)) < 0x10000})
    assert n < index.tables.read("postings", index.POSTINGS).where("NOT trigram RLIKE '[^\\x00-\\uFFFF]'").count() and grams > n
    # Another session, and rules of which the index knew nothing.
    again = secrets.TextIndex(spark.newSession(), str(tmp_path / "index"))
    more = (secrets.Rule("note", r"nothing (here|there)"), secrets.Rule("tail", r"tail[0-9]"))
    postings = again.postings(more)
    files = {f.split("bucket=")[1].split("/")[0] for f in postings.inputFiles() if "bucket=" in f}
    looked = again.candidate_texts(more, postings).collect()
    assert again.buckets == 8 and 0 < len(looked) < len(held) / 3 and files
    assert all("nothing" in r.text or "tail" in r.text for r in looked)
    brute = sorted(str([(m.start(), k, m.end()) for k, x in enumerate(more) for m in re.finditer(x.regex, t)]) for t in texts if t)
    got = sorted(str([(s.start, s.kind, s.end) for s in r.spans]) for r in again.find(more).collect())
    assert got == [x for x in brute if x != "[]"]
    # The rules of old, one of which needs all texts.
    want = sorted(str(r.spans) for r in secrets.scan(rows.unionByName(rows.where("doc_id < 6")).unionByName(docs.select("doc_id", "text"))).collect() if r.spans)
    assert sorted(str(r.spans) for r in again.find().collect()) == want


def test_an_index_of_nothing(spark, empty, tmp_path):
    index = secrets.TextIndex(spark, str(tmp_path / "none"))
    assert index.find().isEmpty()
    index.add(empty)
    assert index.find().isEmpty() and index.find((secrets.Rule("x", "[0-9]+"),)).isEmpty()
