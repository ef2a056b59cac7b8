import numpy as np
import pytest

from markweave.llm import embedding_dedup
from tests.llm.brute import reach

SCHEMA = "vec_id long, label int, embedding array<float>"


def table(spark, n=160, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = [(i, int(i % 3), [float(x) for x in (centres[i % 12] + rng.normal(size=16) * (0.02 if i % 2 else 0.3)).astype(np.float32)]) for i in range(n)]
    rows += [(n + i, 0, rows[0][2]) for i in range(5)] + [(n + 5, None, rows[0][2]), (n + 6, 0, None), (n + 7, 0, [0.0] * 16), (n + 8, 0, [float("nan")] + [1.0] * 15), (n + 9, 0, [None] + [1.0] * 15), (n + 10, 0, []), (n + 11, 0, [1.0, 2.0]), (n + 12, 0, [2.0, 4.0]), (n + 13, 0, [float("inf")] * 16), (n + 14, 0, [1e-30] * 16), (n + 15, 0, [3e30] * 16)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows, cosine):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {i: (label, np.array(v, np.float32).astype(float)) for i, label, v in rows if label is not None and sound(v)}
    unit = {i: (label, v / np.abs(v).max()) for i, (label, v) in unit.items()}
    links = [(i, j) for i in unit for j in unit if i < j and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] / np.linalg.norm(unit[i][1]) / np.linalg.norm(unit[j][1]) >= cosine]
    least = reach([r[0] for r in rows], links)
    return {r[0]: (sum(r[0] in x for x in links), least[r[0]], least[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("cosine,block,dims", [(0.98, 1024, 6), (0.98, 7, 3), (0.9, 16, 2)])
def test_links_as_brute_force(spark, cosine, block, dims):
    rows, df = table(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, cosine, dims, block).collect()}
    assert got == brute(rows, cosine)


@pytest.mark.parametrize("reach_blocks", [1, 3])
def test_reaches_of_the_sequence(spark, reach_blocks, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "REACH", reach_blocks)
    rows, df = table(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, 0.95, 3, 5).collect()}
    assert got == brute(rows, 0.95)


def test_double_precision(spark):
    angle = np.arccos(0.98)
    at = lambda x: [float(np.cos(x)), float(np.sin(x))]
    rows = [(0, 0, [1e39, 1.0]), (1, 0, [1e39, 1.0]), (2, 1, at(0)), (3, 1, at(angle - 1e-12)), (4, 2, at(0)), (5, 2, at(angle + 1e-12)), (6, 3, [1e300, 0.0]), (7, 3, [1e-300, 0.0]), (8, 3, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_clashing_columns(spark):
    rows, df = table(spark)
    from pyspark.sql import functions as F

    more = df.withColumns({c: F.lit(c) for c in ("cid", "emb", "n", "block", "place", "ra", "_l", "_e", "least", "root")})
    assert {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(more).collect()} == {i: n for i, (n, _, _) in brute(rows, 0.98).items()}


def test_leaf_pairs_lose_nothing():
    rng = np.random.default_rng(5)
    a, b = rng.random((300, 3)), rng.random((200, 3))
    near = {(i, j) for i in range(300) for j in range(200) if ((a[i] - b[j]) ** 2).sum() <= 0.01}
    seen = {(i, j) for x, y in embedding_dedup._leaf_pairs(a, b, 0.1, False) for i in range(x.start, x.stop) for j in range(y.start, y.stop)}
    assert near <= seen


def test_no_rows_and_repeated_ids(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).isEmpty()
    twice = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [0.0, 1.0])], SCHEMA)
    assert sorted((r.vec_id, r.n_links) for r in embedding_dedup.near_vectors(twice).collect()) == [(1, 0), (1, 1), (2, 1)]
