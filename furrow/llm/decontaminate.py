"""Benchmark passages in documents, by embedded edit distance and bit sampling.

Texts are sequences of words: ASCII letters lower-cased, ASCII punctuation and
blanks between words. A document holds an item of n words if one of its windows is
within ``n // 5`` word edits of the item (similarity 0.8 or more). With ``fit`` the window
has any length, so that edits are counted against the best-fitting passage and a document
may be shorter than the item; otherwise it has n words. The registered query and the pipeline fit.

Each window and item is embedded by random walks: a walk reads the word under its
pointer and moves on or stays by a random bit of the word and the step, for n
steps, so that few edits become few differing places. A walk needs about 2n steps for
its n words, so within n steps it hardly ever reads past the end, where all texts are equal. From each walk several
small sets of places are sampled and hashed; a window whose sample equals an
item's is a candidate, and the exact edit distance decides. ``WALKS`` times
``SAMPLES`` samples of ``PLACES`` places find windows at the largest distance with
probability 0.95 or more (``tests/llm/test_decontaminate.py`` measures it), and exact copies always.

Only windows that can be within the distance are embedded, without loss: of k + 1
disjoint segments of an item, k edits leave one intact and move it by at most k
words, so windows are placed around the segments that a text holds; and k edits
leave at least n - k words of the window in the item, so windows with fewer words
of the items of that length are left out. Everything per document happens in the
task that reads it. The items go to the tasks in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes; a larger benchmark takes several
passes over the documents.

Items of the same words are one item, named by the smallest id. Items of fewer
than ``LEAST_WORDS`` words cannot be told from chance and match nothing; so do null
and empty texts. Results have one row per document id and item. Empty tables of
either kind give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from furrow.llm import words
from furrow.session import checkpointed, ship_package

LEAST_WORDS = 5
WALKS, SAMPLES, PLACES = 24, 4, 2
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
WINDOWS = 1 << 14  # windows handled at a time
PAIRS = 1 << 20  # colliding samples expanded at a time, or those of one window
TRACED = 512  # windows whose walks are kept at a time
SEED = 23

_PAD = np.uint64(0x7FEDCBA987654321)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def allowed_edits(n: int) -> int:
    return n // 5


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every normalised word."""
    data = words.LOWER[data]
    starts, ends, doc = words.spans(data, offsets, words.MARKS)
    return words.hashes(data, starts, ends), doc


def joined_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring words."""
    many = len(hashes) - size + 1
    out = np.zeros(many, np.uint64)
    for j in range(size):
        out = (out ^ hashes[j : j + many]) * _M1
        out ^= out >> np.uint64(29)
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo .. hi-1, one range after the other."""
    many = hi - lo
    return np.arange(int(many.sum())) - np.repeat(many.cumsum() - many, many) + np.repeat(lo, many)


def _salted(signatures: np.ndarray) -> np.ndarray:
    """All samples in one row; those of different sample sets never compare equal."""
    return (signatures ^ (np.arange(len(signatures), dtype=np.uint64) * _M2)[:, None]).ravel()


def _colliding(marks: np.ndarray, order: np.ndarray, signatures: np.ndarray, items: int) -> Iterator[np.ndarray]:
    """The distinct pairs (window * items + item) that share a sample, in slices of whole windows."""
    samples, many = signatures.shape
    mine = _salted(signatures).reshape(samples, many).T.ravel()
    lo, hi = np.searchsorted(marks, mine, "left"), np.searchsorted(marks, mine, "right")
    reached = (hi - lo).reshape(many, samples).sum(axis=1).cumsum()
    at = 0
    while at < many:
        before = int(reached[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(reached, before + PAIRS, "right")))
        part = slice(at * samples, end * samples)
        owner = np.repeat(np.repeat(np.arange(at, end), samples), (hi - lo)[part])
        yield np.unique(owner * items + order[_ranges(lo[part], hi[part])])
        at = end


def _windows(hashes: np.ndarray, starts: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """``width`` words from each start, end marks after ``length`` of them."""
    step = np.arange(width)
    return np.where(step < length[:, None], hashes[np.minimum(starts[:, None] + step, len(hashes) - 1)], _PAD)


def _share_known(hashes: np.ndarray, starts: np.ndarray, length: np.ndarray, width: int, vocabulary: np.ndarray) -> np.ndarray:
    """How many words of each window are in the vocabulary."""
    out = np.zeros(len(starts), np.int64)
    for at in range(0, len(starts), WINDOWS):
        words_ = _windows(hashes, starts[at : at + WINDOWS], length[at : at + WINDOWS], width)
        spot = np.minimum(np.searchsorted(vocabulary, words_), len(vocabulary) - 1)
        out[at : at + WINDOWS] = (vocabulary[spot] == words_).sum(axis=1)
    return out


# --- embedding -------------------------------------------------------------------------


class Plan:
    """The walks and sampled places for sequences of ``n`` words."""

    def __init__(self, n: int):
        rng = np.random.default_rng([SEED, n])
        self.n, self.steps = n, n
        self.coins = rng.integers(0, 1 << 63, (WALKS, self.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = np.array([[rng.choice(self.steps, min(PLACES, self.steps), replace=False) for _ in range(SAMPLES)] for _ in range(WALKS)])

    def signatures(self, grid: np.ndarray) -> np.ndarray:
        """Samples ``[WALKS * SAMPLES, windows]`` of word hashes ``grid[windows, n or more]``."""
        parts = [self._some(grid[at : at + TRACED]) for at in range(0, len(grid), TRACED)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((WALKS * SAMPLES, 0), np.uint64)

    def _some(self, grid: np.ndarray) -> np.ndarray:
        """All walks go in step; what they read is kept and sampled afterwards."""
        many = len(grid)
        padded = np.concatenate((grid, np.full((many, 1), _PAD)), axis=1).ravel()
        first = (np.arange(many) * (grid.shape[1] + 1))[None, :]
        at, last = np.repeat(first, WALKS, axis=0), first + grid.shape[1]
        steps = int(self.places.max()) + 1
        trace = np.empty((WALKS, steps, many), np.uint64)
        for step in range(steps):
            here = trace[:, step] = padded[at]
            at += ((here * self.coins[:, step, None]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, last, out=at)
        out = np.zeros((WALKS, SAMPLES, many), np.uint64)
        walk = np.arange(WALKS)[:, None]
        for p in range(self.places.shape[2]):
            place = self.places[:, :, p]
            out = (out ^ (trace[walk, place] * _M1 + place[:, :, None].astype(np.uint64))) * _M2
            out ^= out >> np.uint64(32)
        return out.reshape(WALKS * SAMPLES, many)


def _last_row(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edits between each whole row of ``a[m, n]`` and the first n - most .. n + most words of the row of ``b``."""
    (m, n), long = a.shape, b.shape[1]
    width, far = 2 * most + 1, most + n + 1
    shift = np.arange(-most, most + 1)
    row = np.broadcast_to(np.where(shift >= 0, shift, far), (m, width)).astype(np.int32).copy()  # first row: 0 .. most insertions
    edge = np.concatenate((np.zeros((m, most), np.uint64), b, np.zeros((m, n + most - long), np.uint64)), axis=1)
    for i in range(1, n + 1):
        j = i + shift
        inside = (j >= 1) & (j <= long)
        cost = (edge[:, i - 1 : i - 1 + width] != a[:, i - 1 : i]).astype(np.int32)
        new = np.where(inside, row + cost, far)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        if i <= most:
            new[:, most - i] = i  # column 0
        new[:, (j < 0) | (j > long)] = far
        for k in range(1, width):
            np.minimum(new[:, k], new[:, k - 1] + 1, out=new[:, k])
        row = new
    return row


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distance of each row pair of ``a[m, n]`` and ``b[m, n]``, exact up to ``most``, larger beyond."""
    return _last_row(a, b, most)[:, most]


def fitting_distances(a: np.ndarray, b: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Edits between each row of ``a[m, n]`` and the start of ``b[m, n + most]`` that fits it best and has at most ``length`` words."""
    ends = a.shape[1] + np.arange(-most, most + 1)
    return np.where(ends <= length[:, None], _last_row(a, b, most), most + a.shape[1] + 1).min(axis=1)


# --- items -----------------------------------------------------------------------------


class Items:
    """A block of items, indexed by the samples of their embeddings."""

    def __init__(self, ids: list[int], texts: list[str]):
        hashes, doc = word_hashes(*words.flat(pa.array(texts, pa.string())))
        by_words: dict[bytes, int] = {}
        for number in range(len(texts)):
            mine = hashes[doc == number] if len(texts) < 50 else hashes[np.searchsorted(doc, number) : np.searchsorted(doc, number, "right")]
            if len(mine) >= LEAST_WORDS:
                key = mine.tobytes()
                by_words[key] = min(ids[number], by_words.get(key, ids[number]))
        self.vocabulary = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in by_words])) if by_words else np.zeros(0, np.uint64)
        self.groups = []
        segments: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        lengths: dict[int, list[bytes]] = {}
        for key in by_words:
            lengths.setdefault(len(key) // 8, []).append(key)
        for n, keys in sorted(lengths.items()):
            plan = Plan(n)
            grid = np.frombuffer(b"".join(keys), np.uint64).reshape(len(keys), n)
            marks = _salted(plan.signatures(grid))
            order = np.argsort(marks, kind="stable")
            for part in np.array_split(np.arange(n), allowed_edits(n) + 1):
                grams = joined_hashes(grid[:, part].ravel(), len(part))[:: len(part)]
                segments.setdefault(len(part), []).append((grams, len(self.groups), int(part[0])))
            self.groups.append((plan, grid, np.array([by_words[k] for k in keys], np.int64), marks[order], order % len(keys), np.unique(grid)))
        self.segments = []
        for size, found in sorted(segments.items()):
            grams = np.concatenate([g for g, _, _ in found])
            group = np.concatenate([np.full(len(g), x) for g, x, _ in found])
            offset = np.concatenate([np.full(len(g), x) for g, _, x in found])
            _, keep = np.unique(np.stack((grams, group.astype(np.uint64), offset.astype(np.uint64)), axis=1), axis=0, return_index=True)
            keep = keep[np.argsort(grams[keep], kind="stable")]
            coarse = np.zeros(1 << 20, bool)
            coarse[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.segments.append((size, grams[keep], group[keep], offset[keep], coarse))

    def places(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, first word of a window, text): where an intact segment puts the item's start, perhaps before the text's."""
        groups, starts, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, grams, group, offset, coarse in self.segments:
            if len(hashes) < size:
                continue
            mine = joined_hashes(hashes, size)
            near = np.flatnonzero(coarse[(mine & np.uint64((1 << 20) - 1)).astype(np.int64)])
            near = near[doc[near] == doc[near + size - 1]]
            lo, hi = np.searchsorted(grams, mine[near], "left"), np.searchsorted(grams, mine[near], "right")
            spot = _ranges(lo, hi)
            groups.append(group[spot])
            starts.append(np.repeat(near, hi - lo) - offset[spot])
            texts.append(np.repeat(doc[near], hi - lo))
        return np.concatenate(groups), np.concatenate(starts), np.concatenate(texts)

    def matches(self, hashes: np.ndarray, doc: np.ndarray, fit: bool = False) -> np.ndarray:
        """Rows (text, item id, first word, distance), the closest window of each text and item.
        ``fit``: windows of any length; otherwise of the item's."""
        found = []
        if not len(self.vocabulary) or not len(hashes):
            return np.zeros((0, 4), np.int64)
        bounds = np.searchsorted(doc, np.arange(int(doc[-1]) + 2))
        begin = bounds[:-1]
        group, anchors, texts = self.places(hashes, doc)
        order_by_group = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order_by_group], np.arange(len(self.groups) + 1))
        for number in np.flatnonzero(np.diff(edges)).tolist():
            plan, grid, ids, marks, order, vocabulary = self.groups[number]
            n, k = plan.n, allowed_edits(plan.n)
            width, least = (n + k, n - k) if fit else (n, n)
            mine = order_by_group[edges[number] : edges[number + 1]]
            anchor, text = np.unique(np.stack((anchors[mine], texts[mine])), axis=1)
            starts, text = (anchor[:, None] + np.arange(-k, k + 1)).ravel(), np.repeat(text, 2 * k + 1)
            inside = (starts >= begin[text]) & (starts + least <= bounds[text + 1])
            starts = np.unique(starts[inside])
            length = np.minimum(bounds[doc[starts] + 1] - starts, width)
            known = _share_known(hashes, starts, length, width, vocabulary) >= n - k
            starts, length = starts[known], length[known]
            for at in range(0, len(starts), WINDOWS):
                some = starts[at : at + WINDOWS]
                long = length[at : at + WINDOWS]
                windows = _windows(hashes, some, long, width)
                for pairs in _colliding(marks, order, plan.signatures(windows), len(ids)):
                    for cut in range(0, len(pairs), WINDOWS):
                        window, item = np.divmod(pairs[cut : cut + WINDOWS], len(ids))
                        far = fitting_distances(grid[item], windows[window], long[window], k) if fit else edit_distances(windows[window], grid[item], k)
                        good = np.flatnonzero(far <= k)
                        first = some[window[good]]
                        found.append(np.stack((doc[first], ids[item[good]], first - begin[doc[first]], far[good]), axis=1))
        if not found:
            return np.zeros((0, 4), np.int64)
        rows = np.concatenate(found).astype(np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        return rows[first]


# --- Spark jobs ------------------------------------------------------------------------


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of (ids, texts), each within the two bounds or a single item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.regexp_replace(F.translate(F.col(text_col).cast("string"), upper, lower), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ")
    items = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.trim(plain).alias("t")).where("i is not null and t is not null")
    ids, texts, held = [], [], 0
    for row in items.groupBy("t").agg(F.min("i").alias("i")).orderBy("i", "t").toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or held + 4 * len(row["t"]) > BLOCK_BYTES):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        held += 4 * len(row["t"])
    if ids:
        yield ids, texts


def _scan(rows: DataFrame, block: tuple[list[int], list[str]], fit: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        items = Items(*shared.value)
        for batch in batches:
            names = batch.column("_id")
            for lo, _, data, offsets in words.chunks(batch.column("_text")):
                found = items.matches(*word_hashes(data, offsets), fit)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(found[:, 0] + lo)), *(pa.array(found[:, c]) for c in (1, 2, 3))], ["_id", "item_id", "start", "distance"]
                    )

    return rows.mapInArrow(run, "_id bigint, item_id bigint, start bigint, distance bigint")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit: bool = False) -> DataFrame:
    """``doc_id, item_id, start, distance``: the closest window of each document
    and item, counted in words from 0. ``fit``: windows of the best-fitting length,
    not only of the item's. Documents with a null id have a null id here."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = None
    for block in item_blocks(benchmark):
        more = checkpointed(_scan(rows, block, fit), docs.sparkSession, "benchmark-matches")
        found = more if found is None else found.union(more)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start bigint, distance bigint")
    best = found.groupBy(F.col("_id").alias("doc_id"), "item_id").agg(F.min(F.struct("distance", "start")).alias("best"))
    return best.select("doc_id", "item_id", "best.start", "best.distance")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", fit: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; ``fit`` as in ``matches``."""
    ship_package(docs.sparkSession)
    kept, at = docs, docs.columns.index(text_col)
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = Items(*shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in words.chunks(batch.column(at)):
                    clean[items.matches(*word_hashes(data, offsets), fit)[:, 0] + lo] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
