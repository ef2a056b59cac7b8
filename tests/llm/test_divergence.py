"""The source audit against plain sums over all terms and groups."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from markweave.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(UPPER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        share = lambda own, total: {t: 1 + 10**9 * (own[t] + 5) // (total + 5 * len(kept)) for t in kept}
        own = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        all_of = {t: sum(own[s][t] for s in sources) for t in kept}
        p, q = {s: share(own[s], sum(own[s].values())) for s in sources}, share(all_of, sum(all_of.values()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode(), x) for x in sources if x != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in ("wort", "Été", "日本", "x", "Zz", "ÀB") for b in "abcdefghij"]
    out = []
    for i in range(300):
        lang = rng.choice(["en", "de", None])
        source = rng.choice(["s0"] * 5 + [None, "s1", "s2", "s3", "é", "Z", "s4", "s5", "s6"])
        own = vocab[:: 1 + len(source or "") % 2][: rng.choice([5, 20, 60])]
        out.append((i, " ".join(rng.choice(own) + rng.choice(["", ",", "9", " "]) for _ in range(rng.randrange(0, 40))), lang, source))
    return out + [(None, None, "en", "silent"), (3, "", "xx", "a"), (3, "", "xx", "a"), (4, "one", "xx", "b"), (5, "word " * 3, None, None), (6, "wortA9wortA " * 50_000, "en", "s1")]


@pytest.mark.parametrize("light,terms,groups", [(8, 512, 64), (2, 7, 3), (0, 5, 2), (99, 5, 2)])
def test_as_plain_sums(spark, rows, monkeypatch, light, terms, groups):
    for name, x in (("LIGHT", light), ("TILE_TERMS", terms), ("TILE_GROUPS", groups), ("HELD", 200), ("SLICE", 1000)):
        monkeypatch.setattr(divergence, name, x)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows, 6, 5)
    assert {x[2] for x in want} == {"pair", "term"} and any(x[0] == "xx" and x[4] == 0 for x in want)
    got = [tuple(r) for r in divergence.audit(df, 6, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_clashing_columns_and_an_empty_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.withColumns({c: F.lit(c) for c in "term n docs p q z groups first _lang _source total v part item value rank".split()})
    assert {tuple(r) for r in divergence.audit(extra, 6, 5).collect()} == brute(rows, 6, 5)
    assert divergence.audit(df.limit(0)).isEmpty()


def test_shares_are_exact_beyond_longs(spark):
    n, total, v = 9 * 10**12 + 7, 10**13 + 3, 12_345
    got = spark.createDataFrame([(n, total, v)], "n long, t long, v long").select(divergence.share("n", "t").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)
