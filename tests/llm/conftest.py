import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def real(spark):
    """[(id, text, lang, source)] of the smallest documents table."""
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()]


def made(seed=1, n=120):
    """Documents with copies, near copies, shared lines and words of a small vocabulary."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))
    shared, out = [line() for _ in range(6)], []
    for i in range(n):
        if out and rng.random() < 0.4:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            out.append(" ".join(w))
        else:
            out.append("\n".join(rng.choice(shared) if rng.random() < 0.2 else line() for _ in range(rng.randint(1, 8))))
    return [*enumerate(out)]


@pytest.fixture(scope="session")
def documents():
    return made()


SCHEMA = "doc_id long, text string, lang string, source string, `Text` string, id long, n int, h string, c0 int, `a.b` int, __id long, words string, comp long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and long texts, ties, repeated rows, and extra columns that clash."""
    long = "word " * 30_000 + "x" * 50_000 + " 1" * 5_000
    texts = [(None, "a b c d e f g"), (None, None), (1, None), (2, ""), (3, " \t\n \r\n"), (4, long), (5, "to be or not to be\nto be or not to be"), (5, "to be or not to be\nto be or not to be"), (6, "to be or not to be"), (7, "é 漢字 👩‍👧 \u0001"), (8, "one"), (9, "one"), (10, "x" * 3000)]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", "T", 7, None, "h", k, 1, 5, "w", 3) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.where(F.lit(False))
