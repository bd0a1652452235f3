import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
EDGE = [
    (1, "The cat sat on the mat and looked at the dog. " * 12, "en", "a", 5, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, "x"),
    (4, " \t\n ", "de", "b", 3, None),
    (5, "one", "en", None, 3, "x"),
    (6, "one", "en", "b", 3, "x"),
    (6, "one", "en", "b", 3, "x"),
    (None, "one", "fr", "b", 3, "x"),
    (7, "%%% *** !!! 123", "en", "c", 15, "x"),
    (8, LONG, "en", "c", len(LONG), "x"),
    (9, LONG + " tail", "en", "a", len(LONG) + 5, "x"),
    (10, "日本語 テスト <|im_end|> <|endoftext|> \u00e9\u0301 it's", "fr", "a", 20, "x"),
    (11, "nul \x00 byte \x1c x\x85y", "en", "a", 20, "x"),
]
CLASH = "kept string, keep_id string, group_size string, digest string, stats string, quality string, lang_pred string, score string, taken string, size string, sequence_id string, node string, salt string, row string, id string, n string, fp string, pattern string, base_failed string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with the names that operators use."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("mine").alias(c.split()[0]) for c in CLASH.split(", ")])


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r for r in docs.collect()}
