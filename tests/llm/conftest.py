"""A fixture table with the awkward rows that every operator must take."""

import random
import string

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("_words", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("_row", T.StringType()), T.StructField("score", T.StringType())])


def make_rows():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "to"] + ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    texts = {k: "\n".join(prose(rng.randint(6, 40)) for _ in range(rng.randint(1, 6))) for k in range(40)}
    passage = prose(60)
    for k in (3, 9, 17):
        texts[k] = texts[k] + "\n" + passage + " " + prose(5)
    near = (prose(200)).split()
    for k in range(40, 48):
        edited = list(near)
        edited[rng.randrange(200)] = "changed%d" % k
        texts[k] = " ".join(edited)
    texts |= {48: texts[1], 49: texts[1], 50: "", 51: None, 52: " \t\n\r ", 53: "one", 54: "two words", 55: "Three Short Words",
              56: "three short words", 57: "é ñ Ünïcode  nbsp \U0001f600 tail", 58: "\n\n" + texts[2] + "\n\n",
              59: "x" * 5000, 60: " ".join(["again"] * 300), 61: prose(8000),
              62: "password: hunter2hunter2 token=abc secret= token:abcdefgh API_KEY='zzzzzzzz'",
              63: "AKIA" + "A1" * 9 + " then AKIA12 and " + "0af9" * 8 + " é " + "deadbeef" * 3,
              64: "trash " + texts[4], 65: texts[0] + "\n" + texts[0], 66: "a b c d e f g\na b c d e f g\nz\nq r\nz\nq r"}
    rows = [(k, t, ["en", "fr", None, "xx"][k % 4], [None, "s1", "S2", "s1", "z"][k % 5], None if t is None else len(t)) for k, t in texts.items()]
    rows += [rows[5], rows[5], rows[41], (None, "a document without an id, of more than ten words in all here", "en", "s1", 60)]
    return [(*r, "a", "b", "c", "d", "e") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    schema = "doc_id long, quality int, toxic int, score string"
    rows = [(k, int(k % 7 != 0), int(k % 9 == 0), "x") for k in range(70)] + [(3, None, None, "x"), (4, 1, 0, "x"), (None, 1, 1, "x"), (9999, 0, 1, "x")]
    return spark.createDataFrame(rows, schema)
