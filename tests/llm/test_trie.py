"""The prefix trie against a plain one."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from markweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, family=0):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mixed = f"{len(role.encode())}:{role}{text}".encode()
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(mixed).digest(), text))
    path = {c: [(x[1], x[3]) for x in sorted(own[c])] for c in own}
    made = {}
    for c in path:
        b = c - (c % 20 if c >= 0 else -(-c % 20))
        h = crc32(str(c).encode()) % 4 if family and b != c else 0
        made[c] = path.get(b, [])[:h] + path[c][h:]
    members = defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 45), *range(-23, 0), 80, 81, 1000000007]:
        n = rng.randrange(1, 6)
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 3)))))
    for c in range(100, 700):  # copies, more than a chunk of them, and one long talk with a copy that ends earlier
        rows += [(c, 0, "user", "hello  there\x1cx\n y"), (c, 1, "assistant", "hi")]
    rows += [(2000, t, "user", f"turn {t}") for t in range(300)] + [(2001, t, "user", f"turn {t}") for t in range(150)]
    rows += [(3000, None, None, None), (3000, 2, "user", ""), (3000, 2, "user", ""), (3000, 2, "assistant", "z"), (3001, None, "", None), (3020, None, None, "x"), (3021, None, "u", None), (None, 1, "user", "no talk"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("family", [0, 20])
def test_nodes_and_sums(spark, talks, family):
    df = spark.createDataFrame(talks, SCHEMA).repartition(5)
    want = brute(talks, family)
    assert plain(prefix_trie.prefix_trie(df, family)) == want
    extra = df.withColumns({c: F.lit(c) for c in "digest depth words last n value leaf _base _digest parent".split()})
    assert plain(prefix_trie.prefix_trie(extra, family)) == want


def test_a_family_without_turns(spark):
    # Each takes the first turns of a base that isn't there, and has no turns after them.
    rows = [(c, 0, "user", "x") for c in (21, 22, 23, 24, 25, 26, 27)]
    assert plain(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 20)) == brute(rows, 20)


def test_an_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), 20).isEmpty()
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).isEmpty()


def test_rows_follow_the_turns_not_their_square(spark):
    rows = [(c, t, "user", f"{c if t else 0} {t}") for c in range(3) for t in range(400)]
    made = prefix_trie.prefixes(spark.createDataFrame(rows, SCHEMA))
    assert made.count() == 3 * 401
    assert prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).count() == 2 + 3 * 399
