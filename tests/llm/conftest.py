from __future__ import annotations

import pytest

LONG = "alpha beta gamma delta " * 20_000

#: Nulls in every column, empty and very long texts, ties, repeated rows and extra columns with clashing names.
ROWS = [
    (1, "Mail bob.x@mail.example.com or +1 (441) 555-3597 now.", "en", "src0", 10, "x", 1.0),
    (1, "Mail bob.x@mail.example.com or +1 (441) 555-3597 now.", "en", "src0", 10, "x", 1.0),
    (2, None, None, None, None, None, None),
    (3, "", "en", "src1", 0, "y", 2.0),
    (None, "no id here, card 4111 1111 1111 1111 and 10.0.0.1", None, "src0", 5, None, None),
    (None, None, None, None, None, None, None),
    (4, LONG, "en", "src0", len(LONG), "z", 3.0),
    (5, "Mail bob.x@mail.example.com or +1 (441) 555-3597 now.", "de", "src2", 10, "x", 1.0),
    (6, "  \n\t \x0b\x0c\r", "fr", "src2", 9, "x", 1.0),
    (7, "ñandú é x ▁ß \U0001f600 token = \"0123456789abcdef0123456789abcdef01234567\" .", "es", "src2", 10, "x", 1.0),
    (8, "one two three", "en", "src0", 3, "", 0.0),
    (8, "one two three four five", "en", "src0", 3, "", 0.0),
]
CLASHING = ["ids", "fp", "label", "start", "size", "kept", "bucket", "n_words", "held_out", "lang_pred", "item_id", "spans", "text_crc32", "n_pieces"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard double"


@pytest.fixture(scope="session")
def odd(spark):
    """A small table with every awkward case, in several partitions."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.selectExpr("*", *(f"'extra' as {c}" for c in CLASHING)).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA).selectExpr("*", *(f"'extra' as {c}" for c in CLASHING))


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
