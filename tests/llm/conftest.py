import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice("alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared lines and passages, and every odd kind."""
    rng = random.Random(7)
    common, passage = "This line is common to many pages.", words(rng, 120)
    out = []
    for i in range(40):
        body = "\n".join(words(rng, rng.randrange(3, 25)) for _ in range(rng.randrange(1, 6)))
        out.append(body + ("\n" + common if i % 3 == 0 else "") + ("\n" + passage + "\nend" if i % 10 == 0 else ""))
    out += [out[3]] * 6 + [out[5] + " tail" + str(i) for i in range(4)] + [None, "", "", "x", " \n\t ", "Ünïcode 日本語 𝒳 token", words(rng, 9000), "a b c d e f g h " * 30]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 7 % 1000, t, "en", None if i % 11 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, named as operators name theirs."""
    from pyspark.sql import functions as F

    extra = ("shard slot h tk fp n s0 kept spans _row _h _cell _n _d _x value label text_key mix_slot mix_class n_lines n_dropped place n_tokens").split()
    return docs.withColumns({c: F.lit(c) for c in extra})
