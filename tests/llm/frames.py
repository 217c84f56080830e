"""Small document tables for the edge cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, id string, h long, n int, __row int, __number int, entity string"
WORDS = "the of and river stone light under over quick brown fox jumps lazy dog winter summer seven red blue".split()


def sentence(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 9)) for _ in range(n))


def edge_rows():
    """Null and empty texts, null ids, repeated rows, very long texts, ties."""
    long = sentence(1, 60_000)
    texts = [(1, sentence(2, 40)), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, long), (7, sentence(3, 40)),
             (7, sentence(3, 40)), (None, sentence(4, 30)), (None, None), (10, "one"), (11, "ONE"), (12, "\u00e9\u00df \u65e5\u672c \U0001f600 x"),
             (13, "a\n\n\nb  c"), (14, "x" * 20_000), (15, sentence(2, 40) + " and more of it"), (16, "...,,,!!!")]
    return [(i, t, "en" if i != 3 else None, "clash", 1, 2, 3, 4, "e") for i, t in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3, "doc_id")


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(df, folder):
    """The same rows as a table read from files."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
