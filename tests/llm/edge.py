"""Rows that every operator must take: nulls, empties, long texts, ties, repeats and columns with clashing names."""

import random

from pyspark.sql import functions as F

CLASHES = ("size", "shard", "score", "spans", "items", "id", "n", "key", "t", "a", "b", "digest", "end", "h", "media", "copies",
           "target", "lang_pred", "n_words", "source_size", "predicted", "width", "_digest", "_u", "_size", "license_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def rows():
    rng = random.Random(5)
    long = sentence(rng, 30_000, 5_000)
    base = sentence(rng, 60)
    edited = base.split()
    edited[30] = "other"
    out = [(1, base, "en", "s1", 1), (2, base, "en", "s1", 1), (2, base, "en", "s1", 1), (3, " ".join(edited), "en", None, None),
           (4, None, None, None, None), (5, "", "en", "s1", 0), (6, " \n\t ", "en", "s2", 3), (7, "one", "de", "s2", 3),
           (8, "one two", None, "s2", 3), (9, long, "en", "s3", 5), (10, long + " end", "en", "s3", 5), (None, base, "en", "s1", 1),
           (None, None, None, None, None), (11, "Ünï çödé 東京 " * 5, "fr", "é", 1), (12, "!!! ??? 123", "fr", "s2", 1)]
    out += [(100 + i, sentence(rng, rng.randrange(1, 80)), "en", f"s{i % 4}", 1) for i in range(40)]
    return out


def edge_docs(spark, clash=True):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    return df.withColumns({c: F.lit("kept") for c in CLASHES}) if clash else df


def none(spark):
    return spark.createDataFrame([], SCHEMA)
