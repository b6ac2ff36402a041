import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(r, n):
    some = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "Über", "naïve", "x1", "quux", "zeta", "omega", "rho"]
    return " ".join(r.choice(some) + r.choice(["", "", "", ",", ".", ".\n"]) if r.random() < 0.6 else f"n{r.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, blanks, short, very long, equal, near and shared texts, repeated rows, equal ids, null ids."""
    r = random.Random(7)
    base = [prose(r, 120) for _ in range(6)]
    shared = prose(r, 60)
    texts = [None, "", " \n\t", "one", "two words", "a b c", *base, *base[:3], base[0]]
    for b in base[:4]:
        w = b.split(" ")
        for k in (1, 2, 5):
            v = w[:]
            for _ in range(k):
                v[r.randrange(len(v))] = f"edit{r.randrange(999)}"
            texts.append(" ".join(v))
    texts += [f"{prose(r, 30)} {shared} {prose(r, 20)}" for _ in range(5)]
    texts += [prose(r, 20) + " tick tock" * 60, "é" * 700, prose(r, 6000), shared + " " + base[1]]
    out = [(i, t, r.choice(["en", "de"]), r.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    out += [out[6], out[6], (7, "another text under a used id", "en", "b", 5), (None, base[2], "en", "a", 1), (None, None, None, None, None)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
