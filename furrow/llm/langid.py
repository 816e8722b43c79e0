"""Language by segmentation-marginalised unigram models.

Every language has one probability per piece of a fixed public vocabulary (all
pieces of a published tokenizer, whatever their length, plus all single bytes, so
that any text can be segmented). The probability of a word, with the space before
it, is the sum over all its segmentations of the product of its pieces'
probabilities, found by a forward pass over its bytes; a text's is the product
over its words. Piece probabilities come from expectation maximisation over the
same sum, on a bounded sample of training rows per language (``SAMPLE`` rows,
those with the smallest hashed ids; whole texts).

Words are scored once per distinct word and chunk of texts, and may have any
length. One of more than ``WORD_BYTES`` bytes is taken in stretches between places
that no piece found in it covers: every segmentation cuts there, so the sum over
the word is the product of the sums over its stretches. Sums too small for a
double are taken again in logarithms.

The score is the share of the best language in the sum over languages. ``und``
with score 0 stands for a text that is null or has no letter, and for every text
where nothing could be learned. Language, source and id never enter a score.
Rows are kept one for one; ties go to the language that sorts first.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from furrow.llm import words
from furrow.session import ship_package

WORD_BYTES = 48  # longer words are taken in stretches, where that is the same sum
CELLS = 1 << 18  # bytes of words walked through at once
TINY = 1e-200  # sums below are taken in logarithms: what a double lost on the way is no part of larger ones
SAMPLE = 400  # training rows per language
LANGUAGES = 256  # more labels than this are refused
ROUNDS = 4
FLOOR = 1e-2  # smoothing count of a piece
UNKNOWN = "und"


# --- vocabulary ------------------------------------------------------------------------


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[bytes]:
    """Pieces as bytes, the word mark as a space; all single bytes first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if piece:
                found.add(piece)
    return sorted(found, key=lambda p: (len(p), p))


@dataclass
class Vocabulary:
    """A tree of the pieces' beginnings: for each one that goes on, the next by the class of the next byte."""

    classes: np.ndarray  # of each byte; 0 goes nowhere
    inner: int  # beginnings that go on; they come first
    steps: np.ndarray  # (beginning, class, next beginning)
    piece: np.ndarray  # id of each beginning that is a piece, else -1
    lengths: np.ndarray  # bytes of each piece
    size: int
    longest: int

    @classmethod
    def of(cls, pieces: list[bytes]) -> Vocabulary:
        inner = sorted({p[:n] for p in pieces for n in range(len(p))}, key=lambda p: (len(p), p))
        goes_on = set(inner)
        number = {p: i for i, p in enumerate([*inner, *(p for p in pieces if p not in goes_on)])}
        used = sorted({b for p in pieces for b in p})
        classes = np.zeros(256, np.intp)
        classes[used] = np.arange(1, len(used) + 1)
        steps = np.array([(number[p[:-1]], classes[p[-1]], i) for p, i in number.items() if p], np.int32).reshape(-1, 3)
        piece = np.full(max(len(number), 1), -1, np.int32)
        piece[[number[p] for p in pieces]] = np.arange(len(pieces))
        lengths = np.array([len(p) for p in pieces], np.int64)
        return cls(classes, max(len(inner), 1), steps, piece, lengths, len(pieces), int(lengths.max(initial=1)))

    @functools.cached_property
    def table(self) -> np.ndarray:
        """[beginnings that go on, classes]; 0 where there is no next one."""
        table = np.zeros((self.inner, int(self.classes.max()) + 1), np.int32)
        table[self.steps[:, 0], self.steps[:, 1]] = self.steps[:, 2]
        return table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}  # every process spreads it out for itself


# --- the sum over segmentations --------------------------------------------------------


def _walk(codes: np.ndarray, at: np.ndarray, stride: int, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per piece length from 1: (places, ids) of the pieces that begin at ``at``, in its order.

    The next byte of a piece lies ``stride`` further; class 0 ends all of them."""
    width, table = vocabulary.table.shape[1], vocabulary.table.ravel()
    node, ahead = np.zeros(len(at), np.intp), at
    while len(at):
        node = table[node * width + codes[ahead]]
        live = np.flatnonzero(node)
        node, at, ahead = node[live], at[live], ahead[live] + stride
        ids = vocabulary.piece[node]
        hit = np.flatnonzero(ids >= 0)
        yield at[hit], ids[hit]
        more = np.flatnonzero(node < vocabulary.inner)
        node, at, ahead = node[more].astype(np.intp), at[more], ahead[more]


def _found(block: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, piece length, word numbers, ids) of the pieces in equally long words ``block[n, length]``, by start."""
    n, length = block.shape
    codes = np.zeros((length + 1, n), np.intp)
    codes[:-1] = vocabulary.classes[block.T]
    codes, step = codes.ravel(), max(1, CELLS // max(n, 1))
    for low in range(0, length, step):
        high = min(low + step, length)
        levels = []
        for at, ids in _walk(codes, np.arange(low * n, high * n), n, vocabulary):
            levels.append((at, ids, np.searchsorted(at, np.arange(low, high + 1) * n).tolist()))
        for start in range(low, high):
            for k, (at, ids, cut) in enumerate(levels):
                a, b = cut[start - low], cut[start - low + 1]
                if a < b:
                    yield start, k + 1, at[a:b] - start * n, ids[a:b]


def forward(block: np.ndarray, vocabulary: Vocabulary, probs: np.ndarray, logs: bool = False) -> np.ndarray:
    """Probability of each word under each model; ``probs[size + 1, models]``. Logarithms of both with ``logs``."""
    ring = min(block.shape[1], vocabulary.longest) + 1  # no piece reaches further
    alpha = np.full((ring, len(block), probs.shape[1]), -np.inf if logs else 0.0)
    alpha[0], done = 0.0 if logs else 1.0, 0
    for start, n, mine, ids in _found(block, vocabulary):
        if start != done:
            alpha[done % ring], done = -np.inf if logs else 0.0, start
        here, there = alpha[start % ring], alpha[(start + n) % ring]
        whole = len(mine) == len(block)
        value = here if whole else here[mine]
        value = value + probs[ids] if logs else value * probs[ids]
        if whole:
            np.logaddexp(there, value, out=there) if logs else np.add(there, value, out=there)
        else:
            there[mine] = np.logaddexp(there[mine], value) if logs else there[mine] + value
    return alpha[block.shape[1] % ring]


def log_forward(block: np.ndarray, vocabulary: Vocabulary, probs: np.ndarray, log_probs: np.ndarray) -> np.ndarray:
    """Log probability of each word under each model."""
    if block.shape[1] > 2 * WORD_BYTES:
        return forward(block, vocabulary, log_probs, True)
    got = forward(block, vocabulary, probs)
    small = np.flatnonzero((got < TINY).any(axis=1))
    out = np.log(np.maximum(got, TINY))
    if len(small):
        out[small] = forward(block[small], vocabulary, log_probs, True)
    return out


def expected(block: np.ndarray, weight: np.ndarray, vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words under one model ``probs[size + 1]``."""
    length, p = block.shape[1], _logs(probs)
    found = list(_found(block, vocabulary))
    alpha, beta = np.full((2, length + 1, len(block)), -np.inf)
    alpha[0], beta[length] = 0, 0
    for start, n, mine, ids in found:
        alpha[start + n, mine] = np.logaddexp(alpha[start + n, mine], alpha[start, mine] + p[ids])
    total = np.zeros(vocabulary.size)
    for start, n, mine, ids in reversed(found):
        after = beta[start + n, mine] + p[ids]
        beta[start, mine] = np.logaddexp(beta[start, mine], after)
        np.add.at(total, ids, np.exp(alpha[start, mine] + after - alpha[length, mine]) * weight[mine])
    return total


def _logs(probs: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(probs)


def _stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut words longer than ``WORD_BYTES`` where no piece in them covers both neighbours; the third value is the word of each stretch."""
    long = np.flatnonzero(ends - starts > WORD_BYTES)
    every = np.arange(len(starts))
    if not len(long):
        return starts, ends, every
    begins, owners = [np.delete(starts, long)], [np.delete(every, long)]
    for some in np.split(long, np.flatnonzero(np.diff((ends - starts)[long].cumsum() // CELLS)) + 1):
        size = ends[some] - starts[some] + 2  # the space before, and an end that no piece passes
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(some)), size)
        place = np.arange(size.sum()) - base[owner]
        codes = vocabulary.classes[data[np.clip(starts[some][owner] + place - 1, 0, len(data) - 1)]]
        codes[base], codes[base + size - 1] = vocabulary.classes[32], 0
        reach = np.arange(len(codes)) + 1
        for first in range(0, len(codes), CELLS):
            for n, (at, _) in enumerate(_walk(codes, np.arange(first, min(first + CELLS, len(codes))), 1, vocabulary), 1):
                reach[at] = at + n
        reach = np.maximum.accumulate(reach)
        cut = np.flatnonzero((reach[:-1] <= np.arange(1, len(codes))) & (place[1:] > 1) & (place[1:] < size[owner[1:]] - 1)) + 1
        begins.append(np.concatenate([starts[some], starts[some][owner[cut]] + place[cut] - 1]))
        owners.append(some[np.concatenate([np.arange(len(some)), owner[cut]])])
    begin, owner = np.concatenate(begins), np.concatenate(owners)
    order = np.argsort(begin, kind="stable")
    begin, owner = begin[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True)
    return begin, np.where(last, ends[owner], np.append(begin[1:], 0)), owner


def by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, rows: int = 16_384):
    """(word numbers, bytes[n, length]) of equally long words; ``first`` marks parts that begin a word and get a space."""
    length = ends - starts + first
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cut):
        n = int(length[group[0]]) if len(group) else 0
        step = max(1, min(rows, CELLS // max(n, 1)))
        for at in range(0, len(group), step):
            part = group[at : at + step]
            places = starts[part, None] - first[part, None] + np.arange(n)
            block = data[np.maximum(places, 0)]
            block[first[part].astype(bool), 0] = 32
            yield part, block


def log_probabilities(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Log probability of each text under each model."""
    n, models = len(offsets) - 1, probs.shape[1]
    out = np.zeros((n, models))
    starts, ends, doc = words.spans(data, offsets)
    if not len(starts):
        return out
    begin, end, owner = _stretches(data, starts, ends, vocabulary)
    first = (begin == starts[owner]).astype(np.int64)
    h = words.hashes(data, begin, end) ^ (first.astype(np.uint64) << np.uint64(63))
    _, shown, place = np.unique(h, return_index=True, return_inverse=True)
    logs, log_probs = np.empty((len(shown), models)), _logs(probs)
    for part, block in by_length(data, begin[shown], end[shown], first[shown]):
        logs[part] = log_forward(block, vocabulary, probs, log_probs)
    for m in range(models):
        out[:, m] = np.bincount(doc[owner], logs[place, m], n)
    return out


# --- model -----------------------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    probs: np.ndarray  # [size + 1, languages]


def fit_texts(texts: dict[str, list[bytes]], pieces: list[bytes]) -> Model:
    """Expectation maximisation per language, from uniform probabilities per piece length."""
    vocabulary, languages = Vocabulary.of(pieces), sorted(texts)
    probs = np.zeros((vocabulary.size + 1, len(languages)))
    for m, lang in enumerate(languages):
        data, offsets = words.flat(pa.array(texts[lang], pa.binary()))
        starts, ends, _ = words.spans(data, offsets)
        if not len(starts):
            probs[:-1, m] = 1 / vocabulary.size
            continue
        begin, end, owner = _stretches(data, starts, ends, vocabulary)
        first = (begin == starts[owner]).astype(np.int64)
        h = words.hashes(data, begin, end) ^ (first.astype(np.uint64) << np.uint64(63))
        _, shown, count = np.unique(h, return_index=True, return_counts=True)
        blocks = list(by_length(data, begin[shown], end[shown], first[shown], 4096))
        p = np.append(10.0 ** (-1.5 - vocabulary.lengths / 2), 0.0)
        p /= p.sum()
        for _ in range(ROUNDS):
            total = np.full(vocabulary.size, FLOOR)
            for part, block in blocks:
                total += expected(block, count[part].astype(float), vocabulary, p)
            p[:-1] = total / total.sum()
        probs[:, m] = p
    return Model(languages, vocabulary, probs)


def train_rows(id_col: str = "doc_id", folds: int = 4, held: int = 2) -> Column:
    """Rows that may be learned from, by checksum of the id as text."""
    return (F.crc32(F.col(id_col).cast("string")) % folds) != held


def fit(docs: DataFrame, allowed: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> Model:
    """Learn from at most ``SAMPLE`` rows of each language among the allowed ones."""
    usable = docs.where(allowed & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    order = F.xxhash64(F.col(id_col)).alias("_order")
    keyed = usable.select(F.col(lang_col).cast("string").alias("lang"), order)
    counts = keyed.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # Per language, a cut on the hash that keeps about SAMPLE rows; the exact
    # bound is applied to what is left.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * SAMPLE / r["count"]))]) if counts else None
    if share is None:
        return Model([], Vocabulary.of(read_pieces(vocabulary or default_vocabulary())), np.zeros((0, 0)))
    near = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"), order)
    near = near.where(F.pmod("_order", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    few = near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "text"))).where(F.col("_n") <= SAMPLE)
    texts: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in few.orderBy("lang", "_n").toLocalIterator():
        texts[r["lang"]].append(bytes(r["text"]))
    return fit_texts(texts, read_pieces(vocabulary or default_vocabulary()))


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score`` added."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("_text"))

    def run(batches):
        model = shared.value
        for batch in batches:
            every = batch.column("_text")
            for lo, hi, data, offsets in words.chunks(every):
                pred, best = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                if model.languages:
                    logs = log_probabilities(data, offsets, model.vocabulary, model.probs)
                    top = logs.argmax(axis=1)
                    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    raw = data.tobytes()
                    for i in range(hi - lo):
                        if has_letter(raw[offsets[i] : offsets[i + 1]]):
                            pred[i], best[i] = model.languages[top[i]], share[i]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(pred, pa.string()), pa.array(best)], [*keep, "lang_pred", "score"]
                )

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "_text")
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    model = fit(slim, train_rows(), vocabulary=vocabulary)
    return predict(slim.select("doc_id", F.coalesce(~train_rows(), F.lit(False)).alias("held_out"), "text"), model)
