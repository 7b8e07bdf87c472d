import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or (doc_id, text) pairs, with an extra column whose name clashes with inner ones."""

    def make(texts, extra=True):
        rows = [(*(t if isinstance(t, tuple) else (i, t)), "en", "s", None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        return df.selectExpr("*", "'x' as n", "1 as row", "2 as key", "'t' as label") if extra else df

    return make


@pytest.fixture(scope="session")
def sentences():
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make
