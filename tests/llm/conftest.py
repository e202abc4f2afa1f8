import random

import pytest
from pyspark.sql import types as T

#: Extra columns whose names clash with names used inside the operators, in any case.
EXTRA = ["id", "TH", "t", "n", "rec", "runs", "spans", "kept", "line", "pos", "bucket", "n_words", "_row", "_runs", "value"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in EXTRA])


def edge_rows():
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    prose = lambda n: "\n".join(" ".join(rnd.choice(vocab) for _ in range(11)) for _ in range(n))
    copied = prose(9)
    long = prose(2500)
    texts = [(1, None), (2, ""), (3, " \n\t\n"), (None, copied), (4, copied), (4, copied), (5, copied.replace("w1 ", "x1 ", 1)),
             (6, prose(30)), (6, prose(31)), (7, "one"), (8, "One"), (9, "one two"), (10, long), (11, long + "\nend of it"),
             (12, "A\r\nb\x0bc\x85d"), (13, "é" * 50 + " ß ŒΣ İ 中文 \U0001f600"), (None, None), (None, None),
             (14, 'token = "0123456789abcdef0123456789abcdef"'), (15, "x " * 100)]
    return [(i, t, None if k % 5 == 4 else "en", None if k % 7 == 3 else f"src{k % 3}", None, *["x"] * len(EXTRA))
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
