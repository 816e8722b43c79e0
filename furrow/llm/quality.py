"""Quality scores from random-indexing word vectors and a small network.

Every word has a sparse random index vector (two signed entries, from its hash).
The vector of a word bucket is the sum of the index vectors of the words beside
its words, over all documents; the same is kept for buckets of word endings. The
sums are whole numbers, made per task in a table of fixed size and added up by
block of buckets, so they are exact and do not depend on the partitioning. A
document is the mean of its words' two vectors, plus the mean product of
neighbouring index vectors (repetition) and its length. A two-layer network is
trained on a bounded sample of labelled documents (``SAMPLE`` rows, those with
the smallest hashed ids); a part of the sample that it does not see sets the
temperature of its probabilities.

Labels, language, source and id never enter a score. Null and empty texts are
pooled to zero vectors and scored like any other. Labels that are null are not
used; of several labels of one id the smallest counts. Without both classes in
the sample every score is the share of label 1 (0.5 without labels). Rows are
kept one for one, ties and repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from furrow.llm import words
from furrow.session import ship_package

BUCKETS, DIMS = 4096, 32
BLOCK = 256  # buckets added up together
ENDING = 3  # bytes of a word ending
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, STEP, DECAY = 32, 60, 512, 0.01, 1e-4
SEED = 11
FEATURES = 2 * DIMS + 2


# --- vectors ---------------------------------------------------------------------------


def _index(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two (position, sign) entries of each word's index vector."""
    place = lambda shift: ((h >> np.uint64(shift)) & np.uint64(DIMS - 1)).astype(np.int64)
    sign = lambda shift: ((h >> np.uint64(shift)) & np.uint64(1)).astype(np.float64) * 2 - 1
    return [(place(20), sign(40)), (place(30), sign(41))]


def _buckets(data, starts, ends) -> tuple[np.ndarray, list[np.ndarray]]:
    h = words.hashes(data, starts, ends)
    tail = words.hashes(data, np.maximum(starts, ends - ENDING), ends)
    return h, [(x % np.uint64(BUCKETS)).astype(np.int64) for x in (h, tail)]


def add_contexts(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Add the neighbours of every word to ``table[2, BUCKETS * DIMS]``."""
    starts, ends, doc = words.spans(data, offsets)
    if len(starts) < 2:
        return
    h, buckets = _buckets(data, starts, ends)
    beside = np.flatnonzero(doc[1:] == doc[:-1])
    for place, sign in _index(h):
        for kind, bucket in enumerate(buckets):
            for own, other in ((beside, beside + 1), (beside + 1, beside)):
                table[kind] += np.bincount(bucket[own] * DIMS + place[other], sign[other], BUCKETS * DIMS).astype(np.int64)


def pooled(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of each text, from unit-length bucket vectors ``table[2, BUCKETS, DIMS]``."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    starts, ends, doc = words.spans(data, offsets)
    if not len(starts):
        return out
    h, buckets = _buckets(data, starts, ends)
    count = np.bincount(doc, minlength=n)
    full = np.flatnonzero(count)
    first = np.concatenate(([0], np.cumsum(count[full])[:-1]))
    for kind, bucket in enumerate(buckets):
        for at in range(0, len(full), 64):  # a few texts at a time bound the gathered rows
            lo = first[at]
            hi = first[at + 64] if at + 64 < len(full) else len(doc)
            sums = np.add.reduceat(table[kind][bucket[lo:hi]], first[at : at + 64] - lo, axis=0)
            out[full[at : at + 64], kind * DIMS : (kind + 1) * DIMS] = sums / count[full[at : at + 64], None]
    same = np.flatnonzero(doc[1:] == doc[:-1])
    (p1, s1), (p2, s2) = _index(h)
    product = np.zeros(len(same))
    for pa_, sa in ((p1, s1), (p2, s2)):
        for pb, sb in ((p1, s1), (p2, s2)):
            product += (pa_[same] == pb[same + 1]) * sa[same] * sb[same + 1]
    out[:, 2 * DIMS] = np.bincount(doc[same], product, n) / np.maximum(count, 1)
    out[:, 2 * DIMS + 1] = np.log1p(count)
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit-length bucket vectors over all documents; 1 MB whatever the input."""
    ship_package(docs.sparkSession)
    blocks = BUCKETS // BLOCK

    def count(batches):
        table = np.zeros((2, BUCKETS * DIMS), np.int64)
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column(0)):
                add_contexts(table, data, offsets)
        parts = table.reshape(2 * blocks, BLOCK * DIMS)
        used = np.flatnonzero(parts.any(axis=1))
        for b in used.tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "sums": pa.array([parts[b].astype("<i8").tobytes()], pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                more = np.frombuffer(sums, "<i8")
                held[b] = held[b] + more if b in held else more
        for b, sums in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "block int, sums binary"
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema)
    rows = parts.repartition(2 * blocks, "block").mapInArrow(add, schema).collect()  # one row per block
    table = np.zeros((2 * blocks, BLOCK * DIMS))
    for row in rows:
        table[row["block"]] += np.frombuffer(row["sums"], "<i8")
    table = table.reshape(2, BUCKETS, DIMS)
    norm = np.linalg.norm(table, axis=2, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


# --- network ---------------------------------------------------------------------------


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    share: float | None = None  # set where there was nothing to train on

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the logistic loss; every fifth row sets the temperature."""
    if len(set(y.tolist())) < 2:
        return Model(vectors, np.zeros(FEATURES), np.ones(FEATURES), [], share=float(y.mean()) if len(y) else 0.5)
    calibrate = np.arange(len(y)) % 5 == 4
    if len(set(y[calibrate].tolist())) < 2:
        calibrate[:] = False
    fit_x, fit_y = x[~calibrate].astype(float), y[~calibrate].astype(float)
    mean, spread = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    model = Model(vectors, mean, spread, layers)
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    z, t = (fit_x - mean) / spread, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            w1, b1, w2, b2 = layers
            mid = np.tanh(z[rows] @ w1 + b1)
            err = (1 / (1 + np.exp(-np.clip(mid @ w2 + b2, -60, 60))) - fit_y[rows]) / len(rows)
            back = err[:, None] * w2 * (1 - mid**2)
            grads = [z[rows].T @ back + DECAY * w1, back.sum(axis=0), mid.T @ err + DECAY * w2, np.array([err.sum()])]
            t += 1
            for w, g, m, v in zip(layers, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    if calibrate.any():
        raw, truth = model.logits(x[calibrate]), y[calibrate]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(truth == 1, -raw, raw) / g).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


# --- Spark jobs ------------------------------------------------------------------------


def bounded_labels(labels: DataFrame, allowed: Column, limit: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``doc_id, label`` of at most ``limit`` labelled ids, smallest hashed id first."""
    rows = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label is not null").where(allowed)
    return rows.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def features(docs: DataFrame, vectors: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the feature vector of each text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # 1 MB

    def run(batches):
        for batch in batches:
            every = batch.column("_text")
            for lo, hi, data, offsets in words.chunks(every):
                x = pooled(shared.value, data, offsets)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), lists], [*keep, "x"])

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "_text")
    return rows.mapInArrow(run, f"{kinds}, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> Model:
    """Word vectors from all documents, network from a bounded labelled sample."""
    vectors = word_vectors(docs, text_col)
    sample = F.broadcast(bounded_labels(labels, allowed, limit))  # at most ``limit`` rows
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("_text")).join(sample, "doc_id")
    # A repeated id would train on more rows than ids; the bound holds for rows too.
    rows = features(chosen, vectors, ["doc_id", "label"], "_text").orderBy(F.xxhash64("doc_id"), "doc_id", F.col("x")).limit(limit).collect()
    x = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), FEATURES)
    return train(vectors, x, np.array([r["label"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``out``, which must be new."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [shared.value.scores(pooled(shared.value.vectors, data, offsets)) for _, _, data, offsets in words.chunks(batch.column(at))]
            column = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def train_rows(id_col: str = "doc_id", folds: int = 3, held: int = 1) -> Column:
    """Rows that may be learned from, by checksum of the id as text."""
    return (F.crc32(F.col(id_col).cast("string")) % folds) != held


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = score(slim, fit(slim, labels, train_rows()), "text").drop("text")
    held = F.coalesce(~train_rows(), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more."""
    name = "_furrow_score"
    model = fit(docs, labels, train_rows(), text_col=text_col)
    return score(docs, model, text_col, name).where(F.col(name) >= 0.5).select(*docs.columns)
