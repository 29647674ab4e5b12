import hashlib
import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from `(doc_id, text[, lang[, source]])`."""

    def table(rows):
        full = [(*r, *("en", "s", 0)[len(r) - 2 :]) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCS)

    return table


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def words(n, seed, vocabulary=2000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
