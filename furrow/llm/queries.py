"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from furrow.llm import align, decontaminate, langid, periods, pieces, pii, quality, rules, sharding, simhash, tokens, warc, wordbpe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark, d):
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"), fit=True)


@query
def op2_warc(spark, d):
    records = warc.archive_pages(table(spark, d, "pages"), min_revisit_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op3_simhash(spark, d):
    return simhash.with_fingerprint_text(simhash.near_duplicates(table(spark, d, "documents")))


@query
def op4_pii(spark, d):
    return pii.find(table(spark, d, "documents"))


@query
def op5_sharding(spark, d):
    rows = sharding.shard_by_bytes(table(spark, d, "documents"), 8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "byte_start"
    )


@query
def op6_sentencepiece(spark, d):
    return pieces.encode_documents(table(spark, d, "documents").select("doc_id", "text"))


@query
def op7_language(spark, d):
    return langid.predictions(table(spark, d, "documents"))


@query
def op8_quality(spark, d):
    return quality.predictions(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op9_rules(spark, d):
    rows = rules.verdicts(table(spark, d, "documents"), table(spark, d, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op10_token_ids(spark, d):
    return tokens.tokenize_to_files(table(spark, d, "documents"))


@query
def op11_periods(spark, d):
    docs = table(spark, d, "documents")
    return periods.digests(periods.with_runs(docs.select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"))), "doc_id")


@query
def op12_alignment(spark, d):
    return align.digests(table(spark, d, "documents"), "doc_id")


@query
def op13_word_bpe(spark, d):
    return wordbpe.digests(wordbpe.encode_documents(table(spark, d, "documents").select("doc_id", "text"), decoded=True), "doc_id")
