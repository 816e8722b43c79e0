"""Periodic runs of words, found on suffix trees.

A run is a stretch of consecutive words with smallest period ``q`` that is at least
``2 q`` and ``least`` words long and that no neighbouring word extends keeping ``q``.
Every run holds a Lyndon word of length ``q`` that is the longest one starting at its
place, under one of two opposite orders of the words (the runs theorem). So two
candidates per place suffice: from a place to the next smaller suffix, under either
order. Each is extended to both sides by common extensions, which are depths of
lowest common ancestors in the suffix tree of the words and of the reversed words;
the trees are built by Ukkonen's algorithm, and the depths where an Euler tour turns
between neighbouring leaves, in a table of minima over powers of two, give each
extension in constant time.

Trees are built for stretches of words only. In a run every stretch of
``ceil(least / 2)`` words has an equal one ``q`` words away, and together they cover
the run. So words that no repeated stretch covers are in no run and cut the text; in
a piece of ``m`` words only repeats at most ``m / 2`` apart count, which cuts further.
This loses nothing, since no run crosses such a cut. Hashes only choose the pieces;
the trees compare words by their bytes.

Null and empty texts, and texts without a word, have no runs and collapse to ''.
Rows are kept one for one, repeated ones too; an empty table gives no rows. A text's
trees take about 700 bytes per word of its longest repetitive piece. Columns named
like the result's are replaced; the text column is not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from furrow.llm import words
from furrow.session import ship_package

LEAST = 12
CHUNK_BYTES = 4 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# --- suffix trees ----------------------------------------------------------------------


class SuffixTree:
    """The suffix tree of a list of whole numbers, by Ukkonen's algorithm.

    The last number must be 0 and occur nowhere else. Nodes are numbers, 0 the root;
    an edge spans ``start`` to ``end`` of the list and ends in the node of that number.
    """

    def __init__(self, text: list[int], kinds: int):
        n = len(text)
        start, end, link = [0], [0], [0]
        child: dict[int, int] = {}  # node * kinds + first number of the edge -> node
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            fresh = 0  # inner node made last, whose link is due
            while waiting:
                if not length:
                    edge = i
                key = node * kinds + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    at = start[below]
                    stop = end[below]
                    span = (stop if stop <= i else i + 1) - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[at + length] == c:
                        if fresh:
                            link[fresh] = node
                        length += 1
                        break
                    inner = len(start)
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    child[key] = inner
                    child[inner * kinds + c] = inner + 1
                    start[below] = at = at + length
                    child[inner * kinds + text[at]] = below
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.size, self.start, self.end = n, start, end
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        self.first = np.searchsorted(keys[order], np.arange(len(start) + 1) * kinds).tolist()

    def tour(self, upwards: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """An Euler tour, as (suffix of each leaf in turn, depth of the node where the
        tour turns before each leaf). Edges go by their first number, upwards or
        downwards, but 0 always comes first."""
        n, start, end, first, below = self.size, self.start, self.end, self.first, self.below
        stack, back = [0], [-1]
        depth = [0] * len(start)
        leaves, turns, turn = [], [], 0
        while stack:
            node, came = stack.pop(), back.pop()
            if came >= 0:
                turn = came
            if end[node] == n:
                leaves.append(n - depth[node])
                turns.append(turn)
                continue
            here = depth[node]
            lo, hi = first[node], first[node + 1]
            down = below[lo:hi]
            # The stack turns the order round.
            if upwards:
                down.reverse()
            elif start[down[0]] == n - 1:
                down.append(down.pop(0))
            for other in down:
                stack.append(other)
                back.append(here)
                depth[other] = here + end[other] - start[other]
            back[-1] = -1  # the first edge goes on from the node, without a turn
        return np.array(leaves), np.array(turns)


class Extensions:
    """Common extensions of suffixes in constant time: the shallowest turn of the
    Euler tour between two leaves is the depth of their lowest common ancestor."""

    def __init__(self, leaves: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        table = [turns.astype(np.int32)]
        while 1 << len(table) <= len(turns):
            half, last = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        # Short levels are padded, so that all levels form one array.
        self.table = np.zeros((len(table), len(turns)), np.int32)
        for level, row in enumerate(table):
            self.table[level, : len(row)] = row

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes ``a`` and ``b``, which differ."""
        a, b = self.rank[a], self.rank[b]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, lo], self.table[level, hi - (1 << level)]).astype(np.int64)


def next_smaller(rank: list[int]) -> list[int]:
    """For every place the next one of smaller rank; the last place has the smallest."""
    last = len(rank) - 1
    out = [last] * len(rank)
    for i in range(last - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = out[j]
        out[i] = j
    return out


def runs_of(ids: list[int], least: int = LEAST) -> np.ndarray:
    """Runs of a list of numbers above 0 as rows ``start, length, period``, in order."""
    m, kinds = len(ids), max(ids, default=0) + 1
    if m < 2:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree([*ids, 0], kinds)
    leaves, turns = tree.tour()
    ahead = Extensions(leaves, turns)
    opposite = np.empty(m + 1, np.int64)
    opposite[tree.tour(upwards=False)[0]] = np.arange(m + 1)
    del tree
    # Up to the next smaller suffix goes the longest Lyndon word that starts at a place.
    roots = [next_smaller(rank.tolist())[:m] for rank in (ahead.rank, opposite)]
    begin, stop = np.tile(np.arange(m), 2), np.array(roots[0] + roots[1])
    right = ahead(begin, stop)
    del ahead
    behind = Extensions(*SuffixTree([*ids[::-1], 0], kinds).tour())
    left = behind(m - begin, m - stop)
    period = stop - begin
    start, length = begin - left, period + left + right
    good = length >= np.maximum(2 * period, least)
    found = np.stack((start[good], length[good], period[good]), axis=1)
    return np.unique(found, axis=0) if len(found) else found


# --- pieces of texts that may hold runs ------------------------------------------------

_FACTOR = pow(0x9E3779B97F4A7C15, 3, 1 << 64)


def repetitive(hashes: np.ndarray, text: np.ndarray, texts: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the pieces outside which no run lies. ``text`` is the text of every word."""
    none = np.zeros(0, np.int64)
    size = (least + 1) // 2
    n = len(hashes) - size + 1
    if n <= 0:
        return none, none
    gram = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        gram += hashes[k : k + n] * np.uint64(factor)
        factor = factor * _FACTOR % (1 << 64)
    gram ^= text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    inside = np.flatnonzero(text[:n] == text[size - 1 :])
    order = inside[np.argsort(gram[inside], kind="stable")]
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    far = len(hashes) + size
    ahead, behind = np.full(n, far), np.full(n, far)
    gap = order[same + 1] - order[same]
    ahead[order[same]], behind[order[same + 1]] = gap, gap
    at = np.flatnonzero(np.minimum(ahead, behind) < far)
    edges = np.searchsorted(text, np.arange(texts + 1))
    lo, hi = edges[text[at]], edges[text[at] + 1]
    while len(at):
        half = (hi - lo) // 2
        near = (ahead[at] <= half) & (at + ahead[at] + size <= hi)
        near |= (behind[at] <= half) & (at - behind[at] >= lo)
        at = at[near]
        cut = np.flatnonzero((np.diff(at) > size) | (text[at[1:]] != text[at[:-1]])) + 1
        first, last = np.append(0, cut), np.append(cut, len(at)) - 1
        if not len(at):
            break
        begin, end = at[first], at[last] + size
        long = end - begin >= least
        held = np.repeat(long, last - first + 1)
        if near.all() and long.all():
            return begin, end
        each = (last - first + 1)[long]
        at, lo, hi = at[held], np.repeat(begin[long], each), np.repeat(end[long], each)
    return none, none


def find(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each run, rows ``start, length, period``, start and end byte of the words).
    Runs are ordered by text, start and period; starts count words from the text's first."""
    starts, ends, text = words.spans(data, offsets)
    first = np.searchsorted(text, np.arange(len(offsets)))
    owner, rows = [], [np.zeros((0, 3), np.int64)]
    if len(starts):
        for lo, hi in zip(*(x.tolist() for x in repetitive(words.hashes(data, starts, ends), text, len(offsets) - 1, least))):
            number: dict[bytes, int] = {}
            raw = data[starts[lo] : ends[hi - 1]].tobytes()
            base = int(starts[lo])
            ids = [number.setdefault(raw[a - base : b - base], len(number) + 1) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
            found = runs_of(ids, least)
            if len(found):
                found[:, 0] += lo - first[text[lo]]
                owner += [int(text[lo])] * len(found)
                rows.append(found)
    return np.array(owner, np.int64), np.concatenate(rows), np.stack((starts, ends)), first


def collapse(data: np.ndarray, owner: np.ndarray, rows: np.ndarray, places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with words joined by one space, without the words
    that some run holds after its first ``period`` words."""
    starts, ends = places
    depth = np.zeros(len(starts) + 1, np.int64)
    base = first[owner] + rows[:, 0]
    np.add.at(depth, base + rows[:, 2], 1)
    np.add.at(depth, base + rows[:, 1], -1)
    kept = np.flatnonzero(depth[:-1].cumsum() == 0)
    size = ends[kept] - starts[kept] + 1  # with the space behind
    total = np.concatenate(([0], size.cumsum()))
    out = np.full(int(total[-1]), 32, np.uint8)
    bounds = np.searchsorted(kept, first)  # kept words before each text
    source = np.arange(int(total[-1])) + np.repeat(starts[kept] - total[:-1], size)
    inner = np.ones(len(out), bool)
    inner[total[1:] - 1] = False
    out[inner] = data[source[inner]]
    # The space behind a text's last word goes.
    filled = bounds[1:] > bounds[:-1]
    stays = np.ones(len(out), bool)
    stays[total[bounds[1:][filled]] - 1] = False
    return out[stays], np.append(0, np.diff(total[bounds]) - filled).cumsum()


# --- Spark jobs ------------------------------------------------------------------------


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` without its text, plus ``runs`` (array of ``start, length, period`` by
    start, then period) and ``collapsed``, the text without what its runs repeat."""
    ship_package(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_col, "runs", "collapsed")]
    # Positions stand for the columns, whose names may clash with anything.
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("body"))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in words.chunks(batch.column(batch.num_columns - 1), CHUNK_BYTES):
                owner, found, places, first = find(data, offsets, least)
                raw, at = collapse(data, owner, found, places, first)
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], fields=list(RUN)))
                texts = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes()))
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, runs, texts], [*(f"c{i}" for i in range(len(keep))), "runs", "collapsed"])

    kinds = [f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keep))]
    out = rows.mapInArrow(run, ", ".join([*kinds, "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"]))
    return out.toDF(*keep, "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one in ten documents (crc32 of the id) one whose words repeat
    periodically from a place on; words are then joined by one space. Null ids keep theirs."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    part = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(part)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(part, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.array_join(F.concat(F.slice(part, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), whole).otherwise(text)


def digests(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the number of runs, the longest run and SHA-256 digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return rows.select(
        *keep, F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        *keep, "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
