"""SentencePiece ids with seeded merge-dropout, and decoding.

Merges follow a published BPE model: of all neighbouring symbols whose join is a
piece, the best-scored pair merges first, the leftmost of equals. With dropout a
candidate merge is skipped for good when a hash of the seed, the variant, the
segment and the candidate's three edges falls under the rate, so the same key
always gives the same segmentation and another key gives another. A document's
variant is a hash of its id, one of ``variants``.

No piece of the model holds a space after another character, or certain control
characters, so texts are cut there and each distinct segment of a chunk is merged once. Segments
of equal length merge in step, one numpy row each; segments over ``IN_STEP``
characters use a heap.

A text gets one space in front, as the model expects, and spaces become the word
mark. Characters without a piece, and word marks that stand in the text itself,
are spelled in byte pieces, so decoding gives back every text exactly.

Null texts have null ids, empty ones none. Null document ids share variant 0.
Rows are kept one for one. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from furrow.llm import words
from furrow.session import ship_package

MARK = "▁"
RATE = 0.1
VARIANTS = 8
SEED = 17
IN_STEP = 64
CHUNK_BYTES = 2 << 20  # texts encoded together; positions and symbols take some fifty times as much
NONE = np.int64(1 << 40)  # rank of a pair that is no piece

_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Pieces:
    """Tables of one model. Symbols are piece ids, or ``-1 - code point`` where there is no piece."""

    of_char: np.ndarray  # code point -> id or -1
    pair_slots: np.ndarray  # open addressing: packed pair, 0 where free
    pair_rank: np.ndarray
    pair_id: np.ndarray
    spelled: list[bytes]
    first_byte: int
    probes: int
    alone: np.ndarray  # control characters that no piece holds, by byte

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        text, spelled, first_byte = {}, [b""] * size, None
        for i in range(size):
            if model.is_byte(i):
                first_byte = i if first_byte is None else first_byte
                spelled[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                text[model.id_to_piece(i)] = i
                spelled[i] = model.id_to_piece(i).replace(MARK, " ").encode()
        of_char = np.full(0x110000, -1, np.int64)
        for piece, i in text.items():
            if len(piece) == 1:
                of_char[ord(piece)] = i
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"texts cannot be cut with piece {piece!r}")
        of_char[32], of_char[ord(MARK)] = of_char[ord(MARK)], -1
        joined = [p for p in text if len(p) > 1]
        ranks = {score: r for r, score in enumerate(sorted({-model.get_score(text[p]) for p in joined}))}
        pairs = {}
        for p in joined:
            for k in range(1, len(p)):
                if p[:k] in text and p[k:] in text:
                    pairs[(text[p[:k]] << 20 | text[p[k:]]) + 1] = (ranks[-model.get_score(text[p])], text[p])
        bits = max(4, (4 * len(pairs)).bit_length())
        slots, found, ids = np.zeros(1 << bits, np.int64), np.full(1 << bits, NONE, np.int64), np.full(1 << bits, -1, np.int64)
        keys = np.array(list(pairs), np.int64)
        home = (_mix(keys.astype(np.uint64)) & np.uint64((1 << bits) - 1)).tolist()
        probes = 1
        for key, at, (rank, joint) in zip(keys.tolist(), home, pairs.values()):
            tries = 1
            while slots[at]:
                at, tries = (at + 1) & ((1 << bits) - 1), tries + 1
            slots[at], found[at], ids[at], probes = key, rank, joint, max(probes, tries)
        held = {ord(c) for p in text for c in p}
        alone = np.array([b < 32 and b not in held for b in range(256)])
        return cls(of_char, slots, found, ids, spelled, first_byte, probes, alone)

    def find(self, left: np.ndarray, right: np.ndarray, values: np.ndarray, none: int) -> np.ndarray:
        """The value kept for the join of each pair, ``none`` where it is no piece."""
        out = np.full(len(left), none, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[open_] << 20 | right[open_]) + 1
        at = (_mix(key.astype(np.uint64)) & np.uint64(len(self.pair_slots) - 1)).astype(np.int64)
        for _ in range(self.probes):
            here = self.pair_slots[at]
            hit = here == key
            out[open_[hit]] = values[at[hit]]
            more = ~hit & (here != 0)
            if not more.any():
                break
            open_, key, at = open_[more], key[more], (at[more] + 1) & (len(self.pair_slots) - 1)
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the join of each pair: smaller merges first; equal ranks merge from the left."""
        return self.find(left, right, self.pair_rank, int(NONE))

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.find(left, right, self.pair_id, -1)


# --- merging ---------------------------------------------------------------------------


def _skipped(key: np.ndarray, start, mid, end, rate: float) -> np.ndarray:
    """Whether the keyed hash drops the candidates with these edges."""
    if rate <= 0:
        return np.zeros(len(key), bool)
    edges = start.astype(np.uint64) * _K1 + mid.astype(np.uint64) * _K2 + end.astype(np.uint64) * _K3
    return (_mix(key ^ edges) >> np.uint64(11)).astype(np.float64) < rate * (1 << 53)


def merge_heap(pieces: Pieces, symbols: np.ndarray, key: int, rate: float) -> np.ndarray:
    """Merge one segment with an agenda of candidates."""
    n = len(symbols)
    sym, start = symbols.tolist(), list(range(n + 1))
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    keys = np.array([key], np.uint64)
    agenda: list[tuple] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if i < 0 or j >= n:
            return
        rank = int(pieces.ranks(np.array([sym[i]]), np.array([sym[j]]))[0])
        end = start[nxt[j]]
        if rank < NONE and not _skipped(keys, np.array([start[i]]), np.array([start[j]]), np.array([end]), rate)[0]:
            heapq.heappush(agenda, (rank, i, sym[i], j, sym[j], end))

    for i in range(n):
        offer(i)
    while agenda:
        rank, i, a, j, b, end = heapq.heappop(agenda)
        if not (alive[i] and alive[j]) or sym[i] != a or sym[j] != b or nxt[i] != j or start[nxt[j]] != end:
            continue
        sym[i], alive[j], nxt[i] = int(pieces.joins(np.array([a]), np.array([b]))[0]), False, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return np.array([s for s, ok in zip(sym, alive) if ok], np.int64)


def merge_in_step(pieces: Pieces, symbols: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Merge equally long segments ``symbols[n, length]``: (symbols, how many are left per row)."""
    n, length = symbols.shape
    result, left = symbols.copy(), np.full(n, length)
    if length < 2:
        return result, left
    sym = symbols.copy()
    edge = np.tile(np.arange(length + 1), (n, 1))
    rank = np.full((n, length), NONE, np.int64)

    def price(rows: np.ndarray, i: np.ndarray) -> None:
        """Rank the pair at column ``i`` of each row."""
        found = pieces.ranks(sym[rows, i], sym[rows, i + 1])
        hit = np.flatnonzero(found < NONE)
        if len(hit):
            r, c = rows[hit], i[hit]
            found[hit[_skipped(keys[live[r]], edge[r, c], edge[r, c + 1], edge[r, c + 2], rate)]] = NONE
        rank[rows, i] = found

    live = np.arange(n)
    width = length
    for i in range(length - 1):
        price(np.arange(n), np.full(n, i))
    while True:
        at = rank[:, : width - 1].argmin(axis=1) if width > 1 else np.zeros(len(sym), np.int64)
        best = rank[np.arange(len(sym)), at]
        done = best >= NONE
        if done.any():
            rows = live[done]
            result[rows, :width], left[rows] = sym[done, :width], width
            stay = ~done
            sym, edge, rank, live, at, best = sym[stay], edge[stay], rank[stay], live[stay], at[stay], best[stay]
        if not len(sym):
            return result, left
        rows = np.arange(len(sym))
        sym[rows, at] = pieces.joins(sym[rows, at], sym[rows, at + 1])
        # All live rows have merged equally often, so they close up together.
        columns = np.arange(width - 1)
        take = columns[None, :] + (columns[None, :] > at[:, None])
        sym[:, : width - 1] = np.take_along_axis(sym[:, :width], take, 1)
        edge[:, :width] = np.take_along_axis(edge[:, : width + 1], np.concatenate((take, np.full((len(sym), 1), width)), 1), 1)
        rank[:, : width - 1] = np.take_along_axis(rank[:, :width], take, 1)
        width -= 1
        rank[:, width - 1] = NONE
        inner = np.flatnonzero(at < width - 1)
        price(inner, at[inner])
        inner = np.flatnonzero(at > 0)
        price(inner, at[inner] - 1)


def segments(data: np.ndarray, offsets: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Starts of the segments of texts that each begin with a space: text starts,
    spaces after something else, and both sides of characters that no piece holds."""
    if not len(data):
        return np.zeros(0, np.int64)
    space, control = data == 32, alone[data]
    mark = np.zeros(len(data), bool)
    mark[1:] = (space[1:] & ~space[:-1]) | control[1:] | control[:-1]
    mark[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(mark)


def prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty."""
    full = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][full], 32), offsets + np.concatenate(([0], full.cumsum()))


def encode(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, variants: np.ndarray, seed: int = SEED, rate: float = RATE):
    """(ids of all texts, number of ids per text) for texts in one buffer."""
    n = len(offsets) - 1
    data, offsets = prefixed(data, offsets)
    starts = segments(data, offsets, pieces.alone)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    ends = np.append(starts[1:], len(data))
    doc = np.searchsorted(offsets, starts, "right") - 1
    own = words.hashes(data, starts, ends)
    salt = np.array([seed], np.uint64) * _K1
    key = _mix(own ^ _mix(salt + variants[doc].astype(np.uint64) * _K2)) if rate > 0 else own
    _, shown, place = np.unique(key, return_index=True, return_inverse=True)
    size, same = ends - starts, shown[place]
    owner = np.repeat(np.arange(len(starts)), size)
    if (size != size[same]).any() or (data != data[starts[same][owner] + (np.arange(len(data)) - starts[owner])]).any():
        shown, place = np.arange(len(starts)), np.arange(len(starts))  # two segments share a hash: no sharing in this chunk
    raw = data.tobytes()
    parts = [raw[a:b].decode("utf-8") for a, b in zip(starts[shown].tolist(), ends[shown].tolist())]
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
    symbols = pieces.of_char[points]
    symbols = np.where(symbols < 0, -1 - points, symbols)
    length = np.array([len(p) for p in parts], np.int64)
    first = length.cumsum() - length
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
    keys = key[shown]
    order = np.argsort(length, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        chars = int(length[group[0]])
        for at in range(0, len(group), 16_384):
            rows = group[at : at + 16_384]
            if chars > IN_STEP:
                for r in rows.tolist():
                    found[r] = merge_heap(pieces, symbols[first[r] : first[r] + chars], int(keys[r]), rate)
                continue
            merged, left = merge_in_step(pieces, symbols[first[rows, None] + np.arange(chars)], keys[rows], rate)
            for r, line, k in zip(rows.tolist(), merged, left.tolist()):
                found[r] = line[:k]
    pool = np.concatenate(found)
    count = np.array([len(f) for f in found], np.int64)
    pool, count = _spell(pieces, pool, count)
    begin = count.cumsum() - count
    each = count[place]
    before = each.cumsum() - each
    ids = pool[np.repeat(begin[place] - before, each) + np.arange(int(each.sum()))]
    return ids, np.bincount(doc, each, n).astype(np.int64)


def _spell(pieces: Pieces, pool: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace symbols without a piece by byte pieces."""
    odd = np.flatnonzero(pool < 0)
    if not len(odd):
        return pool, count
    spelled = [chr(-1 - s).encode() for s in pool[odd].tolist()]
    width = np.ones(len(pool), np.int64)
    width[odd] = [len(b) for b in spelled]
    out = np.repeat(pool, width)
    out[out < 0] = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64) + pieces.first_byte
    owner = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(owner, width, len(count)).astype(np.int64)


def decode(pieces: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes of all texts, offsets): the exact texts that ``encode`` was given."""
    pool = np.frombuffer(b"".join(pieces.spelled), np.uint8)
    size = np.array([len(s) for s in pieces.spelled], np.int64)
    begin = size.cumsum() - size
    each = size[ids]
    before = each.cumsum() - each
    data = pool[np.repeat(begin[ids] - before, each) + np.arange(int(each.sum()))]
    owner = np.repeat(np.arange(len(count)), count)
    length = np.bincount(owner, each, len(count)).astype(np.int64)
    offsets = np.concatenate(([0], length.cumsum()))
    lead = offsets[:-1][length > 0]  # the space in front
    return np.delete(data, lead).tobytes(), offsets - np.concatenate(([0], (length > 0).cumsum()))


# --- Spark jobs ------------------------------------------------------------------------


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
    rate: float = RATE, variants: int = VARIANTS, seed: int = SEED, keep_ids: bool = True,
) -> DataFrame:
    """``docs`` without its text, plus ``n_pieces``, ``ids_crc32``, ``lossless`` and, if wanted, ``ids``.

    Columns of ``docs`` with these names are replaced. ``lossless`` says that the ids were decoded again and gave the text.
    """
    ship_package(docs.sparkSession)
    path = model or default_model()
    keep = [c for c in docs.columns if c not in (text_col, "n_pieces", "ids_crc32", "lossless", "ids")]
    variant = F.coalesce(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(variants)), F.lit(0))
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"), F.when(F.col(id_col).isNull(), 0).otherwise(variant).cast("bigint").alias("_variant"))
    added = "n_pieces bigint, ids_crc32 bigint, lossless boolean" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        pieces = Pieces.load(path)
        for batch in batches:
            every = batch.column("_text")
            variant = batch.column("_variant").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in words.chunks(every, CHUNK_BYTES):
                ids, count = encode(pieces, data, offsets, variant[lo:hi], seed, rate)
                back, places = decode(pieces, ids, count)
                whole = data.tobytes()
                if back == whole and (places == offsets).all():
                    good = [True] * (hi - lo)
                else:
                    good = [back[places[i] : places[i + 1]] == whole[offsets[i] : offsets[i + 1]] for i in range(hi - lo)]
                ends = count.cumsum()
                plain = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(plain[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), count.tolist())]
                text = every.slice(lo, hi - lo)
                gone = np.asarray(text.is_null())
                columns = [*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(count), pa.array(sums, pa.int64()), pa.array(good)]
                names = [*keep, "n_pieces", "ids_crc32", "lossless"]
                if keep_ids:
                    at = pa.array(np.concatenate(([0], ends)).astype(np.int32), mask=np.append(gone, False))
                    columns.append(pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [f"`{c}` {t}" for c, t in rows.dtypes if c not in ("_text", "_variant")]
    return rows.mapInArrow(run, ", ".join([*kinds, added]))
