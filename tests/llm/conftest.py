import random

import pytest
from pyspark.sql import types as T

#: further columns whose names clash with those of documents and of the operators' own tables
EXTRA = ("TEXT", "key", "c0", "Doc_Id", "n_chars")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType() if c != "n_chars" else T.LongType()) for c in EXTRA])


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "k", "c", "d", None if t is None else len(t)) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\n "), (None, "alone with no id here at all"), (4, "one"), (5, "one"), (5, "one"), (6, prose(1, 30000)), (7, "!!! ... ???"), (None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
