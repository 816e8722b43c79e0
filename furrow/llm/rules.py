"""Quality rules: fixed counts per text, and a hashed n-gram likelihood ratio.

Base counts come first: words, their characters, symbols, repeated lines and
words in repeated three-word windows. A text fails the base rules with fewer than
``LEAST_WORDS`` words or with more than half of its words in repeated windows.

The method compares two multinomials over hashed word unigrams and bigrams
(``BUCKETS`` buckets): one of trusted documents, one of all documents. A text's
score is the sum of the log ratios of its n-grams, divided by their number. The
threshold is the score that best separates the trusted from the distrusted
documents, over every labelled one (balanced accuracy over a histogram), so
the verdict on every document is a fixed function of its text and the counts.

Counts cover all documents, those of the trusted side every document labelled
trusted; they are combined before the shuffle, to one row per bucket and task. The
threshold is chosen over all labels in the same way, one row per bin and task. Everything on the rows is SQL functions, and
texts are scored without a shuffle. Windows found twice are
detected inside the row by sorting their hashes, in n log n for a text of n
words; texts whose window hashes are all distinct skip the sort.

Null and empty texts have no words, score zero and fail the base rules. Rows are
kept one for one. Without trusted documents the two multinomials are equal and
only the base rules decide. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, functions as F

from furrow.session import checkpointed

LEAST_WORDS = 50
BUCKETS = 1 << 14
SMOOTHING = 1.0
SAMPLE = 20_000  # labelled ids of ``bounded_sample``
BIN = 0.01  # width of a score bin when the threshold is chosen
SPACE = r"[\\x20\\x09-\\x0D]"


# --- counts of one text ----------------------------------------------------------------


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """Add ``_text`` (never null) and ``_words``."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    bare = "trim(both ' \\t\\n\\u000b\\u000c\\r' from _text)"
    rows = rows.withColumn("_bare", F.expr(bare))
    return rows.withColumn("_words", F.expr(f"if(_bare = '', cast(array() as array<string>), split(_bare, '{SPACE}+', -1))")).drop("_bare")


def _repeated_words(windows: str) -> str:
    """SQL for the number of words in windows found twice or more, from an array of window hashes."""
    # sort_array compares natively; array_sort calls a lambda per comparison.
    marked = f"sort_array(transform({windows}, (h, i) -> struct(h as h, i as i)))"
    twice = (
        "filter(transform(s, (x, i) -> if(coalesce(get(s, i - 1).h = x.h, false) or coalesce(get(s, i + 1).h = x.h, false), x.i, -1)), p -> p >= 0)"
    )
    covered = "aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0, (a, x) -> a + x)"
    named = lambda value, name, body: f"get(transform(array({value}), {name} -> {body}), 0)"
    return f"if(size(array_distinct({windows})) = size({windows}), 0, {named(marked, 's', named(f'sort_array({twice})', 'p', covered))})"


def with_counts(rows: DataFrame) -> DataFrame:
    """Add the base counts to rows that have ``_text`` and ``_words``."""
    rows = rows.withColumn("n_words", F.size("_words").cast("bigint"))
    windows = "if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))))"
    rows = rows.withColumn("_windows", F.expr(windows))
    lines = "filter(split(_text, '\\n', -1), x -> trim(both ' \\t\\n\\u000b\\u000c\\r' from x) <> '')"
    rows = rows.withColumn("_lines", F.expr(lines))
    return rows.select(
        *[c for c in rows.columns if c not in ("_windows", "_lines")],
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(f"cast({_repeated_words('_windows')} as bigint)").alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words"))


# --- n-grams ---------------------------------------------------------------------------


def ngram_buckets(words: str = "_words") -> Column:
    """Bucket of every word and of every pair of neighbouring words."""
    one = f"transform({words}, w -> cast(pmod(xxhash64(w), {BUCKETS}) as int))"
    two = f"transform(slice({words}, 2, greatest(size({words}) - 1, 0)), (w, i) -> cast(pmod(xxhash64(get({words}, i), w), {BUCKETS}) as int))"
    return F.expr(f"concat({one}, {two})")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, ratio``: at most ``BUCKETS`` rows. ``trusted`` has every trusted id once, and may be large."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_raw"))
    # Trusted ids grow with the corpus: merged at every size, so that the texts move once whatever Spark expects of them.
    marked = slim.join(trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_trusted")).hint("merge"), "_id", "left")
    grams = with_words(marked, "_raw").select("_trusted", F.explode(ngram_buckets()).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")).collect()  # one row per bucket
    raw, target = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    base = math.log((raw + SMOOTHING * BUCKETS) / (target + SMOOTHING * BUCKETS))
    rows = [Row(bucket=r["bucket"], ratio=base + math.log((r["target"] + SMOOTHING) / (r["raw"] + SMOOTHING)) if target else 0.0) for r in counts]
    return docs.sparkSession.createDataFrame(rows, "bucket int, ratio double")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def with_scores(docs: DataFrame, ratios: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, the base counts and ``score`` per row.

    The ratios, at most ``BUCKETS`` rows, become one constant array by bucket, so that
    a row's n-grams are looked up and summed inside the row, in the order of its words.
    """
    by_bucket = {r["bucket"]: r["ratio"] for r in ratios.collect()}
    table = F.split(F.lit(",".join(repr(by_bucket.get(b, 0.0)) for b in range(BUCKETS))), ",").cast("array<double>")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_raw"))
    rows = with_counts(with_words(slim, "_raw").drop("_raw")).select("doc_id", *COUNTS, ngram_buckets().alias("_buckets"))
    total = F.aggregate("_buckets", F.lit(0.0), lambda a, b: a + F.get(table, b))
    # Six places do not show in which order doubles were added.
    return rows.select("doc_id", *COUNTS, F.round(total / F.greatest(F.size("_buckets"), F.lit(1)), 6).alias("score"))


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The bin edge that separates the labels best (``doc_id, label``, every id once, any
    number of them); minus infinity where one label is missing."""
    bins = (
        scored.where(~F.col("base_failed"))
        .select("doc_id", "score")
        .join(labels.hint("merge"), "doc_id")
        .groupBy(F.floor(F.col("score") / BIN).alias("bin"))
        .agg(F.sum((F.col("label") == 1).cast("long")).alias("good"), F.sum((F.col("label") != 1).cast("long")).alias("bad"))
        .orderBy("bin")
        .collect()  # scores are bounded by the smoothing, so bins are few
    )
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return -math.inf
    best, edge, lost, caught = 1.0, -math.inf, 0, 0
    for r in bins:
        lost, caught = lost + r["good"], caught + r["bad"]
        value = (1 - lost / good) + caught / bad
        if value > best + 1e-12:
            best, edge = value, (r["bin"] + 1) * BIN
    return edge


def distinct_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``doc_id, label`` of every labelled id, once."""
    rows = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return rows.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))


def bounded_sample(labels: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``doc_id, label`` of at most ``limit`` labelled ids, smallest hashed id first."""
    return distinct_labels(labels, id_col, label_col).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``score`` and ``kept`` per row."""
    spark = docs.sparkSession
    known = checkpointed(distinct_labels(labels), spark, "rules-labels")
    ratios = log_ratios(docs, known.where("label = 1"), id_col, text_col)
    scored = checkpointed(with_scores(docs, ratios, id_col, text_col), spark, "rules-scores")
    edge = threshold(scored, known)
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(edge))
    return scored.withColumn("kept", kept)
