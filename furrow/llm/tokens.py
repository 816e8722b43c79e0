"""Token-id files compressed by an adaptive context-mixing range coder.

A file holds the ids of a run of documents. Its ids are cut into blocks; every
block starts from the same state, is coded on its own and has a checksum of its
ids, so any block can be read alone. Within a block two tables remember which id
last followed the previous id (order 1) and the previous two (order 2), with a
confidence each. For every id the predictions are mixed: the weights of "order 2
is right", "order 1 is right" and "order 0" come from counts kept per pair of
confidences, which adapt as the block goes on. Where neither prediction holds,
the id is coded with order-0 frequencies, which the file stores once and every
block starts from. One range coder codes both choices, one after the other.

All blocks of a file are coded in step, one numpy lane per block, so a step costs
the same for a thousand ids as for one.

Layout (little-endian): magic, then the header's length and checksum, then the
header: counts, document ids and lengths, ids present and their frequencies, and
for each block its number of ids, checksum and number of bytes; then the bytes of
all blocks, in words of 16 bits.

Null texts are empty. Null document ids come first and are kept. Ties keep one
entry each. An empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from furrow.llm import files, words
from furrow.session import checkpointed, scratch_path, ship_package

END_ID = 2
BLOCK_IDS = 1024  # ids of a block
FILE_IDS = 1 << 23  # a file is closed after the document that reaches this; a numpy step serves all its blocks
SLOTS = 10  # log2 of the table entries per block and order
CHUNK_BYTES = 4 << 20  # texts encoded together
SURE = 4  # where the confidence of a prediction stops growing
GAIN, LIMIT = 24, 1 << 12  # growth of a mixing count, and the most that counts of a state add up to
SCALE_BITS = 20
SCALE = 1 << SCALE_BITS  # sum of the order-0 frequencies

MAGIC = b"FTOK0002"
NO_ID = np.iinfo(np.int64).min

# State of the coder: 48 bits, of which 16 leave at a time. Its interval holds at
# least 2**32, so both choices can be coded before bits leave: 12 bits go to the
# mixing counts and 20 to order 0.
_WINDOW, _LEAST, _WORD, _KEPT = 1 << 48, 1 << 32, 16, (1 << 32) - 1

# The three mixing counts of a state stand in one integer, 16 bits each; times
# _SUMS they become their running sums.
_FIELD, _ONES = 0xFFFF, 1 | 1 << 16 | 1 << 32
_SUMS, _HALF = _ONES, 0x7FFF * _ONES


# --- model -----------------------------------------------------------------------------


class Mixer:
    """The adaptive state of one block per lane, on ranks of ids among those of the
    file. Both orders are kept in one array, order 1 first. A table entry is
    (rank + 1) * 8 + how sure it is, from 1 to ``SURE``, or 0."""

    def __init__(self, lanes: int):
        self.table = np.zeros(2 * lanes << SLOTS, np.int32)
        self.weights = np.full(lanes * 25, 64 | 32 << 16 | 32 << 32)
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        rows = np.arange(lanes)
        self.base, self.states = np.stack((rows, rows + lanes)) << SLOTS, rows * 25

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """For the first ``n`` lanes and both orders: places, entries and how sure they
        are (0: no prediction); per lane the mixing state and its counts."""
        last = self.last[:n]
        place = np.empty((2, n), np.int64)
        np.right_shift(last * np.uint32(2654435761), 32 - SLOTS, out=place[0], casting="unsafe")
        np.right_shift(last * np.uint32(2246822519) + self.before[:n], 32 - SLOTS, out=place[1], casting="unsafe")
        place += self.base[:, :n]
        held = self.table.take(place)
        sure = held & 7
        state = self.states[:n] + (sure[1] * 5 + sure[0])
        return place, held, sure, state, self.weights.take(state)

    def learn(self, number: np.ndarray, place, held, sure, state, weights, hit, shift, total) -> None:
        """``number``: rank + 1 of the id that came; ``shift``: 16 times the choice that was right."""
        n = len(number)
        replaced = -((sure < 2) > hit).astype(np.int32)  # all bits, or none
        held += (sure < SURE) & hit
        held -= (sure > 1) > hit
        replaced &= held ^ ((number << 3) | 1)
        held ^= replaced
        self.table[place] = held
        weights += GAIN << shift
        large = (total > LIMIT - GAIN).nonzero()[0]
        if len(large):
            weights[large] = ((weights[large] >> 1) & _HALF) + _ONES
        self.weights[state] = weights
        last = self.last[:n]
        np.multiply(last, np.uint32(3266489917), out=self.before[:n])
        last[:] = number


# --- range coder -----------------------------------------------------------------------


class Encoder:
    def __init__(self, lanes: int, most: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, _WINDOW - 1)
        # One row per place and one column per lane: lanes are at about the same place.
        self.out = np.zeros((2 * most + 4) * lanes, np.uint16)
        self.at = np.arange(lanes)

    def put(self, n: int, first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> None:
        """Code two choices in each of the first ``n`` lanes: (start, size, total), and (start, size) of ``SCALE``."""
        low, span = self.low[:n], self.range[:n]
        start, size, total = first
        unit = span // total
        start *= unit
        low += start
        np.multiply(unit, size, out=unit)
        unit >>= SCALE_BITS
        start, size = second
        start *= unit
        low += start
        np.multiply(unit, size, out=span)
        self._carry((low >= _WINDOW).nonzero()[0])
        move = (span < _LEAST).nonzero()[0]
        while len(move):
            self._send(move)
            move = move[span.take(move) < _LEAST]

    def _carry(self, lanes: np.ndarray) -> None:
        """Add one to what was sent by lanes whose ``low`` has run over."""
        self.low[lanes] -= _WINDOW
        place = self.at.take(lanes)
        while len(place):
            place = place - len(self.at)
            word = self.out.take(place) + np.uint16(1)
            self.out[place] = word
            place = place[word == 0]

    def _send(self, lanes: np.ndarray) -> None:
        low, place = self.low.take(lanes), self.at.take(lanes)
        self.out[place] = low >> 32
        self.at[lanes] = place + len(self.at)
        self.low[lanes] = (low & _KEPT) << _WORD
        self.range[lanes] = self.range.take(lanes) << _WORD

    def finish(self) -> list[np.ndarray]:
        """The words of each lane. Two more settle the last id, whatever follows them."""
        lanes, every = len(self.low), np.arange(len(self.low))
        self.low += (1 << _WORD) - 1
        self._carry(np.flatnonzero(self.low >= _WINDOW))
        for _ in range(2):
            self._send(every)
        used = self.at // lanes
        lines = np.ascontiguousarray(self.out.reshape(-1, lanes)[: int(used.max())].T)
        return [lines[i, :n] for i, n in enumerate(used.tolist())]


class Decoder:
    """``code`` is how far the sent value lies above the interval's lower end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, np.uint16))).astype(np.uint16)
        lanes = len(starts)
        self.at, self.range, self.code = starts.copy(), np.full(lanes, _WINDOW - 1), np.zeros(lanes, np.int64)
        for _ in range(3):
            self.code = (self.code << _WORD) | self.data.take(self.at, mode="clip")
            self.at += 1

    def choice(self, n: int, weights: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """16 times the first choice of each of the first ``n`` lanes, and where it ends up in ``SCALE``."""
        code, span = self.code[:n], self.range[:n]
        unit = span // ((sums >> 32) & _FIELD)
        shift = (code >= unit * (sums & _FIELD)).astype(np.int64)
        shift += code >= unit * ((sums >> 16) & _FIELD)
        shift <<= 4
        code -= unit * (((sums << 16) >> shift) & _FIELD)
        unit *= (weights >> shift) & _FIELD
        unit >>= SCALE_BITS
        span[:] = unit
        return shift, code // unit

    def take(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        """Go on behind the second choice."""
        code, span = self.code[:n], self.range[:n]
        start *= span
        code -= start
        span *= size
        move = (span < _LEAST).nonzero()[0]
        while len(move):
            place = self.at.take(move)
            code[move] = (code.take(move) << _WORD) | self.data.take(place, mode="clip")
            self.at[move] = place + 1
            rest = span.take(move) << _WORD
            span[move] = rest
            move = move[rest < _LEAST]


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole numbers of at least 1 that sum to ``SCALE`` and follow the counts."""
    if len(counts) > SCALE // 4:
        raise ValueError("too many different ids for one file")
    spare = SCALE - len(counts)
    freq = 1 + counts.astype(np.int64) * spare // max(int(counts.sum()), 1)
    freq[int(freq.argmax())] += SCALE - int(freq.sum())
    return freq


def _intervals(freq: np.ndarray) -> np.ndarray:
    """Start and size of each rank in order 0, in one integer; last, all of ``SCALE`` for an id that needs no order 0."""
    return np.append((freq.cumsum() - freq) << SCALE_BITS + 1 | freq, SCALE)


def _parted(intervals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return intervals >> SCALE_BITS + 1, intervals & ((2 << SCALE_BITS) - 1)


def encode_blocks(ids: np.ndarray, present: np.ndarray, freq: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Words of each block of ``BLOCK_IDS`` ids, and the blocks' lengths."""
    lanes = -(-len(ids) // BLOCK_IDS)
    sizes = np.full(lanes, BLOCK_IDS)
    if lanes:
        sizes[-1] = len(ids) - (lanes - 1) * BLOCK_IDS  # the short block comes last, so full lanes are a prefix
    numbers = np.zeros(lanes * BLOCK_IDS, np.int32)  # rank + 1
    if len(present) and present[-1] < 1 << 22:  # a table is faster than a search, and small
        number_of = np.zeros(int(present[-1]) + 1, np.int32)
        number_of[present] = np.arange(1, len(present) + 1)
        numbers[: len(ids)] = number_of[ids]
    else:
        numbers[: len(ids)] = np.searchsorted(present, ids) + 1
    steps = np.ascontiguousarray(numbers.reshape(lanes, BLOCK_IDS).T)
    intervals, whole = _intervals(freq), len(freq)
    mixer, coder = Mixer(lanes), Encoder(lanes, BLOCK_IDS)
    for t in range(int(sizes.max(initial=0))):
        n = lanes if t < sizes[-1] else lanes - 1
        number = steps[t, :n]
        place, held, sure, state, weights = mixer.predict(n)
        hit = held >> 3 == number
        right = hit.view(np.uint8)
        shift = np.maximum(right[1] << 5, right[0] << 4).astype(np.int64)
        sums = weights * _SUMS
        total = (sums >> 32) & _FIELD
        rank = np.where(shift > 0, whole, number - 1)
        coder.put(n, (((sums << 16) >> shift) & _FIELD, (weights >> shift) & _FIELD, total), _parted(intervals.take(rank)))
        mixer.learn(number, place, held, sure, state, weights, hit, shift, total)
    return coder.finish() if lanes else [], sizes


def decode_blocks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, present: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks whose words begin at ``starts`` of ``data``."""
    order = np.argsort(-sizes, kind="stable")  # longer lanes first, so that open lanes are a prefix
    lanes, left = len(sizes), sizes[order]
    steps = np.ones((int(left.max(initial=0)), lanes), np.int32)
    mixer, coder = Mixer(lanes), Decoder(data, starts[order])
    intervals, whole = _intervals(freq), len(freq)
    lookup = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    for t in range(len(steps)):
        n = int(np.searchsorted(-left, -t, "left"))
        place, held, sure, state, weights = mixer.predict(n)
        sums = weights * _SUMS
        shift, spot = coder.choice(n, weights, sums)
        rank = lookup.take(spot, mode="clip")
        guess = held >> 3
        number = steps[t, :n]
        np.add(rank, 1, out=number)
        known = shift.nonzero()[0]
        number[known] = guess[(shift[known] >> 4) - 1, known]
        rank[known] = whole
        coder.take(n, *_parted(intervals.take(rank)))
        mixer.learn(number, place, held, sure, state, weights, guess == number, shift, (sums >> 32) & _FIELD)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    lines = np.ascontiguousarray(steps.T)
    for i, lane in enumerate(order.tolist()):
        out[lane] = present.take(lines[i, : sizes[lane]] - 1, mode="clip")
    return out


# --- files -----------------------------------------------------------------------------


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: documents in order, ``lengths`` ids each."""
    ids = ids.astype(np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 29):
        raise ValueError("ids must be from 0 to 2**29 - 1")
    if len(ids) and ids.max() < 1 << 22:
        every = np.bincount(ids)
        present = np.flatnonzero(every)
        counts = every[present]
    else:
        present, counts = np.unique(ids, return_counts=True)
    freq = frequencies(counts) if len(present) else np.zeros(0, np.int64)
    blocks, sizes = encode_blocks(ids, present, freq)
    plain = ids.astype("<u4")
    sums = [zlib.crc32(plain[i * BLOCK_IDS : i * BLOCK_IDS + s].tobytes()) for i, s in enumerate(sizes.tolist())]
    names = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    head = struct.pack("<QQQQ", len(names), len(ids), len(present), len(blocks))
    head += names.tobytes() + np.asarray(lengths, "<u4").tobytes() + present.astype("<u4").tobytes() + freq.astype("<u4").tobytes()
    head += np.asarray(sizes, "<u4").tobytes() + np.array(sums, "<u4").tobytes() + np.array([b.nbytes for b in blocks], "<u4").tobytes()
    head = zlib.compress(head, 6)
    return MAGIC + struct.pack("<QI", len(head), zlib.crc32(head)) + head + b"".join(b.astype("<u2").tobytes() for b in blocks)


def unpack_header(data: bytes) -> dict:
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    size, check = struct.unpack_from("<QI", data, 8)
    raw = data[20 : 20 + size]
    if len(raw) != size or zlib.crc32(raw) != check:
        raise ValueError("token file header is damaged")
    head = zlib.decompress(raw)
    docs, n, kinds, blocks = struct.unpack_from("<QQQQ", head)
    at, out = 32, {"ids": n, "blocks_at": 20 + size}
    for name, kind, count in (
        ("docs", "<i8", docs), ("lengths", "<u4", docs), ("present", "<u4", kinds), ("freq", "<u4", kinds),
        ("sizes", "<u4", blocks), ("sums", "<u4", blocks), ("bytes", "<u4", blocks),
    ):
        out[name] = np.frombuffer(head, kind, count, at).astype(np.int64)
        at += int(kind[2]) * count
    return out


def unpack_blocks(data: bytes, wanted: list[int] | None = None) -> tuple[dict, list[np.ndarray]]:
    """The header and the ids of the wanted blocks (all by default); every block is checked."""
    head = unpack_header(data)
    begin = head["bytes"].cumsum() - head["bytes"]
    chosen = np.arange(len(begin)) if wanted is None else np.array(wanted, np.int64)
    held = int(head["bytes"].sum())
    if len(data) < head["blocks_at"] + held:
        raise ValueError("token file is cut short")
    code = np.frombuffer(data[head["blocks_at"] : head["blocks_at"] + held], "<u2")
    blocks = decode_blocks(code, begin[chosen] // 2, head["sizes"][chosen], head["present"], head["freq"])
    for i, ids in zip(chosen.tolist(), blocks):
        if zlib.crc32(ids.astype("<u4").tobytes()) != head["sums"][i]:
            raise ValueError(f"block {i} is damaged")
    return head, blocks


# --- texts to ids ----------------------------------------------------------------------


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


_IS_BLANK, _IS_ALNUM, _IS_PUNCTUATION, _IS_CONTROL, _IS_WIDE = 1, 2, 4, 8, 16


def _kind(b: int) -> int:
    if b >= 128:
        return _IS_WIDE
    alnum = chr(b).isalnum()
    return _IS_BLANK * bool(_BLANK[b]) | _IS_ALNUM * alnum | _IS_PUNCTUATION * (32 < b < 127 and not alnum) | _IS_CONTROL * (b < 32 or b == 127)


_KINDS = bytes(map(_kind, range(256)))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a byte-level text may be cut without changing its tokens: text
    starts; each space between two bytes that are not blanks, which opens the next
    token whatever stands around it; ASCII punctuation after an ASCII letter or
    digit, where a run of letters or digits ends; and behind a lone line break."""
    if len(data) < 3:
        return np.unique(offsets[:-1][np.diff(offsets) > 0])
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    mark = np.zeros(len(data), bool)
    mark[1:-1] = (data[1:-1] == 32) & ((kind[:-2] | kind[2:]) & _IS_BLANK == 0)
    mark[1:] |= (kind[1:] >> 1) & kind[:-1] & _IS_ALNUM != 0  # _IS_PUNCTUATION is the bit above
    line = np.flatnonzero(data[1:-1] == 10)
    mark[line[((kind[line] & (_IS_BLANK | _IS_WIDE)) | (kind[line + 2] & (_IS_BLANK | _IS_WIDE | _IS_CONTROL))) == 0] + 2] = True
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    mark[inner] = True
    mark[0] = True
    return np.flatnonzero(mark)


# First bytes of characters that may be white space beyond ASCII.
_WIDE_BLANK = np.zeros(256, bool)
_WIDE_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Bank(NamedTuple):
    """Parts encoded so far, and where their ids stand in ``ids``."""

    parts: pa.BinaryArray
    first: np.ndarray
    number: np.ndarray
    ids: np.ndarray


class PartEncoder:
    """Ids of many texts, put together from the ids of their parts. Each distinct part
    of a chunk is encoded once, and parts of earlier chunks are remembered.

    A subclass says where texts may be cut (``cut``), what the ids of given parts are
    (``run``) and which parts may be encoded as one text (``joins``); the byte lengths
    of the tokens (``width``) then tell where each part ends.
    """

    JOINED = 1 << 14  # bytes of parts encoded as one text
    REMEMBER = 1 << 19  # distinct parts kept from earlier chunks
    SHORT = 64  # most bytes of a part that is kept

    def __init__(self, width: np.ndarray):
        none = np.zeros(0, np.int64)
        self.bank = Bank(pa.array([], pa.binary()), none, none, np.zeros(0, np.int32))
        self.width = width

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where parts begin; every text that is not empty begins one."""
        raise NotImplementedError

    def joins(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.zeros(len(begin), bool)

    def run(self, texts: list[bytes]) -> list[np.ndarray]:
        raise NotImplementedError

    def _encode(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts one after the other, ids per part); the parts follow one another in ``raw``."""
        size = ends - starts
        length = np.zeros(len(starts), np.int64)
        pools: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
        together = np.flatnonzero(plain)
        reach = size[together].cumsum()
        split = np.flatnonzero(np.diff(reach // self.JOINED)) + 1
        groups = np.split(together, split) if len(together) else []
        text = np.frombuffer(raw, np.uint8)[np.repeat(plain, size)].tobytes()
        edge = [0, *reach[split - 1].tolist(), len(text)]
        joined = self.run([text[a:b] for a, b in zip(edge, edge[1:])]) if groups else []
        alone = np.flatnonzero(~plain).tolist()
        for group, ids in zip(groups, joined):
            reached = self.width[ids].cumsum()
            last = np.searchsorted(reached, size[group].cumsum())
            if (reached[np.minimum(last, len(reached) - 1)] != size[group].cumsum()).any():
                alone += group.tolist()  # a token spans two parts: not expected, and harmless
                continue
            length[group] = np.diff(last, prepend=-1)
            pools[group[0]] = ids
        for i, ids in zip(alone, self.run([raw[starts[i] : ends[i]] for i in alone])):
            length[i], pools[i] = len(ids), ids
        return self._in_order(pools, length, groups, alone)

    @staticmethod
    def _in_order(pools, length, groups, alone) -> tuple[np.ndarray, np.ndarray]:
        """Lay the ids out in the order of the parts."""
        first = np.zeros(len(length), np.int64)
        held, at, single = [], 0, set(alone)
        for group in groups:
            if int(group[0]) in single:
                continue
            first[group] = at + length[group].cumsum() - length[group]
            held.append(pools[group[0]])
            at += len(held[-1])
        for i in alone:
            first[i] = at
            held.append(pools[i])
            at += len(held[-1])
        pool = np.concatenate(held) if held else np.zeros(0, np.int32)
        before = length.cumsum() - length
        return pool[np.repeat(first - before, length) + np.arange(int(length.sum()))], length

    def _look_up(self, parts: pa.BinaryArray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, number) of the ids of each part in a pool of ids. Parts met in
        earlier chunks are taken from the bank; new ones are encoded and added."""
        known = self.bank
        at = pc.index_in(parts, value_set=known.parts).fill_null(-1).to_numpy()
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        fresh = parts.take(pa.array(new))
        data, offsets = words.flat(fresh)
        ids, length = self._encode(data.tobytes(), offsets[:-1], offsets[1:], plain[new])
        first, number = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        first[old], number[old] = known.first[at[old]], known.number[at[old]]
        first[new], number[new] = len(known.ids) + length.cumsum() - length, length
        pool = np.concatenate((known.ids, ids))
        short = np.flatnonzero(np.diff(offsets) <= self.SHORT)[: max(self.REMEMBER - len(known.parts), 0)]
        if len(short):
            kept = np.zeros(len(new), bool)
            kept[short] = True
            size = length[short]
            self.bank = Bank(
                pa.concat_arrays([known.parts, fresh.take(pa.array(short))]),
                np.concatenate((known.first, len(known.ids) + size.cumsum() - size)),
                np.concatenate((known.number, size)),
                np.concatenate((known.ids, ids[np.repeat(kept, length)])),
            )
        return first, number, pool

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts = self.cut(data, offsets)
        edges = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        place = coded.indices.to_numpy()
        shown = np.empty(len(coded.dictionary), np.int64)
        shown[place[::-1]] = np.arange(len(starts))[::-1]  # where each distinct part comes first
        first, length, pool = self._look_up(coded.dictionary, self.joins(data, starts[shown], edges[shown + 1], offsets))
        each = length.take(place)
        before = np.append(0, each.cumsum())
        ids = pool[np.repeat(first.take(place) - before[:-1], each) + np.arange(int(before[-1]))]
        return ids, np.diff(before[np.searchsorted(starts, offsets)])


class TextEncoder(PartEncoder):
    """Ids by a byte-level model of the tokenizers library.

    Parts that open with a space and a visible character keep their tokens
    wherever they stand, so many of them are encoded as one text. Other parts are
    encoded alone, and so are whole texts that hold a special token's string if
    ``special``: then the string is that token, as in the library's default;
    otherwise it is ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: its characters stand for bytes
        for token, i in vocabulary.items():
            width[i] = len(token)
        super().__init__(width)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold a special token's string and so are not cut."""
        out = np.zeros(len(offsets) - 1, bool)
        raw = data.tobytes() if self.special else b""
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                end = int(offsets[text + 1])
                out[text] |= at + len(token) <= end
                at = raw.find(token, end if out[text] else at + 1)
        return out

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, self.whole = cuts(data, offsets), self._whole(data, offsets)
        if self.whole.any():
            text = np.searchsorted(offsets, starts, "right") - 1
            starts = starts[~self.whole[text] | (starts == offsets[text])]
        return starts

    def joins(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        second = data[np.minimum(begin + 1, len(data) - 1)]
        plain = (data[begin] == 32) & (end - begin > 1) & ~_BLANK[second] & ~_WIDE_BLANK[second]
        return plain & ~self.whole[np.searchsorted(offsets, begin, "right") - 1]

    def run(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]


@functools.cache
def warm(kind: type, *args):
    """One object per worker process and set of arguments: an encoder keeps the parts
    it has met, and later tasks of the process find them there."""
    return kind(*args)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> np.ndarray:
    """``end_id`` after the ids of every text."""
    return np.insert(ids, lengths.cumsum(), end_id)


# --- Spark jobs ------------------------------------------------------------------------

MANIFEST = "part int, number int, file string, docs bigint, ids bigint, bytes bigint"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write all documents in id order and return the manifest of the files."""
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or default_tokenizer()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_tie"))
    # The input position only breaks ties, so that one hot id is spread over partitions.
    placed = rows.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def write(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        encoder, name, number = warm(TextEncoder, path, True), files.attempt_name(), 0
        names, lengths, held, total = [], [], [], 0

        def close():
            ids = np.concatenate(held)
            data = pack(names, np.concatenate(lengths), ids)
            uri = files.write_bytes(folder, f"ids-{name}-{number:06d}.ftok", data)
            row = {"part": [ctx.partitionId()], "number": [number], "file": [uri], "docs": [len(names)], "ids": [len(ids)], "bytes": [len(data)]}
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))

        for batch in batches:
            for lo, hi, data, offsets in words.chunks(batch.column("text"), CHUNK_BYTES):
                ids, count = encoder(data, offsets)
                held.append(with_end(ids, count, end_id))
                lengths.append(count + 1)
                names += batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                total += len(held[-1])
                if total >= FILE_IDS:
                    yield close()
                    number, names, lengths, held, total = number + 1, [], [], [], 0
        if names:
            yield close()

    return checkpointed(placed.mapInArrow(write, MANIFEST), spark, "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add ``start``: ids in all files before. One total per partition is gathered, not one per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("ids").alias("_ids")).select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("_own", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(F.broadcast(totals), "part").select(
        "file", (F.col("_base") + F.col("_own")).alias("start")
    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    spark = manifest.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with files.open_ranges(uri) as f:
                    head, blocks = unpack_blocks(f.read_at(f.size(), 0))
                raw = memoryview(np.concatenate(blocks).astype("<u4").tobytes())
                lengths = head["lengths"]
                first = lengths.cumsum() - lengths
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), lengths.tolist())]
                ids = pa.array(head["docs"], mask=head["docs"] == NO_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(first + start), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = with_starts(manifest).repartition(parts, "file")
    return rows.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenize_to_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids and read all files back."""
    folder = folder or scratch_path(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, folder, tokenizer, id_col, text_col))
