from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from furrow.llm import quality, words


def test_words_match_a_pattern():
    texts = ["", "  a b\tc\n", "é x  y", None, "\x0b\x0c\r", "one", "two three"]
    data, offsets = words.flat(pa.array(texts, pa.string()))
    starts, ends, doc = words.spans(data, offsets)
    got = [(int(d), bytes(data[s:e])) for s, e, d in zip(starts, ends, doc)]
    want = [(i, w.encode()) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert got == want


def test_equal_words_have_equal_hashes():
    data, offsets = words.flat(pa.array(["ab cd ab", "cd abc ab"]))
    starts, ends, _ = words.spans(data, offsets)
    h = words.hashes(data, starts, ends).tolist()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h)) == 3


def test_chunks_cover_all_rows():
    texts = pa.array(["x" * n for n in (0, 5, 9000, 3, 0, 100)])
    parts = list(words.chunks(texts, 64))
    assert [p[0] for p in parts] == [0, *[p[1] for p in parts][:-1]] and parts[-1][1] == 6
    assert sum(len(p[2]) for p in parts) == sum(map(len, texts.to_pylist()))


def test_context_sums_match_a_loop(docs):
    texts = [r.text for r in docs.limit(20).collect()]
    table = np.zeros((2, quality.BUCKETS * quality.DIMS), np.int64)
    data, offsets = words.flat(pa.array(texts, pa.string()))
    quality.add_contexts(table, data, offsets)
    starts, ends, doc = words.spans(data, offsets)
    h, (bucket, tail) = quality._buckets(data, starts, ends)
    want = np.zeros_like(table)
    for i in range(len(h)):
        for j in (i - 1, i + 1):
            if 0 <= j < len(h) and doc[j] == doc[i]:
                for place, sign in quality._index(h[j : j + 1]):
                    want[0, bucket[i] * quality.DIMS + place[0]] += int(sign[0])
                    want[1, tail[i] * quality.DIMS + place[0]] += int(sign[0])
    assert (table == want).all()


def test_vectors_do_not_depend_on_partitions(docs):
    a, b = quality.word_vectors(docs.repartition(1)), quality.word_vectors(docs.repartition(7))
    assert (a == b).all()


def test_held_out_accuracy(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.predictions(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.85
    low, high = got[got.quality == 0].score, got[got.quality == 1].score
    assert np.mean([(h > low).mean() + 0.5 * (h == low).mean() for h in high]) >= 0.75


def test_rows_and_folds(odd, none, labels):
    got = quality.predictions(odd, labels).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert quality.predictions(none, labels).count() == 0


def test_without_labels(odd, labels):
    got = quality.predictions(odd, labels.limit(0)).collect()
    assert {r.score for r in got} == {0.5}
    one = labels.selectExpr("doc_id", "1 as quality")
    assert {r.score for r in quality.predictions(odd, one).collect()} == {1.0}


def test_held_out_labels_do_not_matter(docs, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(~quality.train_rows(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.predictions(docs, labels).orderBy("doc_id").toPandas()
    b = quality.predictions(docs, turned).orderBy("doc_id").toPandas()
    assert np.allclose(a.score, b.score)


@pytest.mark.parametrize("column", ["lang", "source", "doc_id"])
def test_other_columns_do_not_matter(docs, labels, column):
    model = quality.fit(docs, labels, quality.train_rows())
    from pyspark.sql import functions as F

    changed = docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType))
    a = sorted(r.s for r in quality.score(docs, model, "text", "s").collect())
    b = sorted(r.s for r in quality.score(changed, model, "text", "s").collect())
    assert a == b
