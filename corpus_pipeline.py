"""A corpus pipeline over ``documents``: one operator per stage.

Low quality goes, one document of each near-duplicate group stays, documents that
hold a benchmark passage go, personal data is masked, and what is left is turned
into piece ids. Every stage reads the whole table that the one before it wrote.

Stages keep the columns of ``documents`` but for the last, which replaces the text
by its ids. The order matters little for the result and much for the cost: the
cheap row filter comes first, and only kept texts are masked and encoded.

ORACLE_SQL is None: the classifier, the fingerprints, the edit distances and the
merges have no SQL form. ``tests/llm/test_pipeline.py`` checks every stage on its
own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import decontaminate, pieces, pii, quality, simhash
from furrow.llm.queries import table
from furrow.session import checkpointed


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), fit=True)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("pieces", as_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), spark, f"stage-{name}")
    return docs
