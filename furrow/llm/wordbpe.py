"""BPE ids of a word-level vocabulary by forced-boundary splitting, and decoding.

The model lower-cases and composes a text, drops white space, cuts it into words,
numbers and signs, spells each in bytes, marks the last byte as a word end and merges
neighbours, the best-ranked pair first and the leftmost of equals. Every symbol that a
merge makes is in the vocabulary. So two neighbouring bytes that no vocabulary token
holds side by side are never merged into one symbol: between them lies a certain cut,
and the fragments on both sides merge independently of each other. Fragments are
encoded on their own and their ids concatenated. Short fragments recur, so their ids
are remembered, and so are those of whole words.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: special-token
strings in a text become their tokens. ASCII white space is dropped by the model and no
rule of it reaches across, so texts are cut there first. Composing, lower-casing and
cutting words are left to the library's own steps. The model has no decoder: decoding
joins the tokens by spaces, as ``Tokenizer.decode(ids, skip_special_tokens=False)`` does.

Null texts count as empty; empty ones have no ids and decode to ''. Null lists of ids
decode to null. Rows are kept one for one, repeated ones too; an empty table gives no
rows. Columns named like the result's are replaced.
"""

from __future__ import annotations

import heapq
import json
import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from furrow.llm import words
from furrow.llm.tokens import PartEncoder, warm
from furrow.session import ship_package

CHUNK_BYTES = 1 << 20
IN_STEP = 64  # symbols up to which fragments of equal length are merged in step
NONE = np.int64(1 << 40)  # rank of a pair that does not merge
_BLANKS = "\t\n\x0b\x0c\r "
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in _BLANKS]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_character(byte: int) -> str:
    """The character that stands for a byte that is no visible Latin-1 character, by the byte-level rule."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return chr(byte) if byte in shown else chr(256 + sum(b not in shown for b in range(byte)))


class WordBpe(PartEncoder):
    """The encoder of one tokenizer file. Symbols are vocabulary ids."""

    APART = "\0"  # stands between parts that are normalised together
    TOGETHER = 4096  # parts normalised together
    REMEMBER = 1 << 18

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ending, vocabulary = model["model"]["end_of_word_suffix"], model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.tokens = tokens_of(path)
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.pieces = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        # Symbol of each byte character, inside a word and as its last one.
        letters = [t for t in vocabulary if len(t) == 1]
        top = max(map(ord, letters)) + 1
        self.inner, self.last = np.zeros(top, np.int64), np.zeros(top, np.int64)
        for c in letters:
            self.inner[ord(c)], self.last[ord(c)] = vocabulary[c], vocabulary[c + ending]
        # Neighbours that some token holds side by side.
        base = int(max(self.inner.max(), self.last.max())) + 1
        self.held = np.zeros((base, base), bool)
        for ends in (False, True):
            names = [t.removesuffix(ending) for t in vocabulary if t.endswith(ending) == ends]
            symbols, first = self.symbols(names, ends)
            inside = np.setdiff1d(np.arange(len(symbols)), first)
            self.held[symbols[inside - 1], symbols[inside]] = True
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in model["model"]["merges"]]
        self.rank = {(a, b): (i, joint) for i, (a, b, joint) in reversed(list(enumerate(pairs)))}
        # The same sorted by pair, for many pairs at once. Pair 0, 0 stands for none.
        packed = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        self.pairs, at = np.unique(packed, return_index=True)
        self.pair_rank, self.pair_joint = at, np.array([j for _, _, j in pairs], np.int64)[at]
        self._forget()
        super().__init__(np.zeros(0, np.int64))

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict()  # pieces met so far
        self.number.default_factory = self.number.__len__
        self.number[_byte_character(0)]  # a lone mark between parts is no piece
        self.size, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def symbols(self, pieces: list[str], ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all pieces, first symbol of each)."""
        code = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        stop = np.fromiter(map(len, pieces), np.int64, len(pieces)).cumsum()
        out = self.inner[code]
        if ends and len(stop):
            out[stop - 1] = self.last[code[stop - 1]]
        return out, np.append(0, stop[:-1])[: len(pieces)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each pair, or NONE; what it makes)."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], NONE), self.pair_joint[at]

    def merged(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge fragments of equal length in step, one row each: (their places, the symbols left), by number of symbols."""
        done, place = [], np.arange(len(rows))
        rank, joint = self.ranks(rows[:, :-1], rows[:, 1:])
        while rows.shape[1] > 1 and len(rows):
            at = rank.argmin(1)  # the first of equals
            line = np.arange(len(rows))
            stays = rank[line, at] == NONE
            if stays.any():
                done.append((place[stays], rows[stays]))
                place, rows, rank, joint, at = (x[~stays] for x in (place, rows, rank, joint, at))
                line = np.arange(len(rows))
            rows[line, at] = joint[line, at]
            rows = np.take_along_axis(rows, np.arange(rows.shape[1] - 1) + (np.arange(rows.shape[1] - 1) > at[:, None]), 1)
            if rows.shape[1] == 1:
                break
            gone = np.arange(rank.shape[1] - 1) + (np.arange(rank.shape[1] - 1) >= np.minimum(at, rank.shape[1] - 1)[:, None])
            rank, joint = np.take_along_axis(rank, gone, 1), np.take_along_axis(joint, gone, 1)
            for side in (at - 1, at):
                near = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                rank[near, side[near]], joint[near, side[near]] = self.ranks(rows[near, side[near]], rows[near, side[near] + 1])
        return [*done, (place, rows)]

    def merged_long(self, symbols: list[int]) -> list[int]:
        """The same for one fragment, on an agenda and a linked list."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(self.rank[p][0], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self.rank[left, right][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := (symbols[i], symbols[k])) in self.rank:
                    heapq.heappush(agenda, (self.rank[pair][0], i, *pair))
            if (h := before[i]) >= 0 and (pair := (symbols[h], symbols[i])) in self.rank:
                heapq.heappush(agenda, (self.rank[pair][0], h, *pair))
        return [s for s in symbols if s >= 0]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids of each): cut at forced boundaries, merge every fragment alone, concatenate."""
        symbols, first = self.symbols(pieces, True)
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~self.held[symbols[:-1], symbols[1:]]
        cut[first] = True
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(symbols)))
        count = np.ones(len(begin), np.int64)
        out = np.full(len(symbols), -1, np.int64)  # ids of a fragment stand at its first places
        for size in np.unique(length).tolist():
            chosen = np.flatnonzero(length == size)
            if size > IN_STEP:
                for i in chosen.tolist():
                    ids = self.merged_long(symbols[begin[i] : begin[i] + size].tolist())
                    out[begin[i] : begin[i] + len(ids)] = ids
                    count[i] = len(ids)
                continue
            for place, rows in self.merged(symbols[begin[chosen][:, None] + np.arange(size)]):
                out[begin[chosen[place]][:, None] + np.arange(rows.shape[1])] = rows
                count[chosen[place]] = rows.shape[1]
        owner = np.searchsorted(first, begin, "right") - 1
        return out[out >= 0].astype(np.int32), np.bincount(owner, count, len(pieces)).astype(np.int64)

    def _numbers(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers of all parts, pieces of each); special tokens are numbered below 0."""
        joined = self.APART.join(parts)
        if joined.count(self.APART) != len(parts) - 1 or self.split.search(joined):
            out, count = [], []
            for part in parts:
                numbers = []
                for k, text in enumerate(self.split.split(part)):
                    if k % 2:
                        numbers.append(-1 - self.special[text])
                    elif text:
                        # A piece of the text itself may look like the mark.
                        numbers += [self.number[p] or self.number["\0"] for p, _ in self.pieces(self.normalize(text))]
                out += numbers
                count.append(len(numbers))
            return np.array(out, np.int64), np.array(count, np.int64)
        joined = f" {self.APART} ".join(parts)
        number = self.number
        found = np.array([number[p] for p, _ in self.pieces(self.normalize(joined))], np.int64)
        mark = found == 0
        return found[~mark], np.bincount(mark.cumsum()[~mark], minlength=len(parts))

    def _encode(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.REMEMBER:
            self._forget()
        parts = [raw[a:b].decode("utf-8", "replace").strip(_BLANKS) for a, b in zip(starts.tolist(), ends.tolist())]
        found = [self._numbers(parts[at : at + self.TOGETHER]) for at in range(0, len(parts), self.TOGETHER)]
        numbers, count = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        fresh = list(self.number)[len(self.size) :]
        if fresh:
            ids, size = self.encode_pieces([_byte_character(0) if p == "\0" else p for p in fresh])
            self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))
        first = self.size.cumsum() - self.size
        special = numbers < 0
        pool = np.concatenate((self.ids, (-1 - numbers[special]).astype(np.int32)))
        each, at = np.where(special, 1, self.size[np.maximum(numbers, 0)]), np.where(special, len(self.ids) + special.cumsum() - 1, first[np.maximum(numbers, 0)])
        total = np.append(0, each.cumsum())
        ids = pool[np.repeat(at - total[:-1], each) + np.arange(int(total[-1]))]
        return ids, np.diff(total[np.append(0, count.cumsum())])

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A part is a word and the white space behind it."""
        mark = np.zeros(len(data), bool)
        blank = _BLANK[data]
        mark[1:] = blank[:-1] & ~blank[1:]
        mark[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(mark)


def tokens_of(path: str) -> dict[int, bytes]:
    """The spelling of every id of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    return {i: t.encode() for t, i in [*model["model"]["vocab"].items(), *((t["content"], t["id"]) for t in model["added_tokens"])]}


def spell(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens with a space behind each, first byte by id, size by id; unknown ids have none)."""
    size, first = np.zeros(max(tokens) + 1, np.int64), np.zeros(max(tokens) + 1, np.int64)
    for i, raw in tokens.items():
        size[i] = len(raw) + 1
    order = sorted(tokens)
    first[order] = size[order].cumsum() - size[order]
    return np.frombuffer(b"".join(tokens[i] + b" " for i in order), np.uint8), first, size


def decode(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts whose ``count`` ids stand one after the other in ``ids``."""
    pool, first, size = table
    known = (ids >= 0) & (ids < len(size))
    ids = np.where(known, ids, 0)
    each = np.where(known, size[ids], 0)
    ends = np.append(0, each.cumsum())
    out = pool[np.repeat(first[ids] - ends[:-1], each) + np.arange(int(ends[-1]))]
    at = ends[np.append(0, count.cumsum())]
    filled = np.diff(at) > 0
    return np.delete(out, at[1:][filled] - 1), np.append(0, np.diff(at) - filled).cumsum()


# --- Spark jobs ------------------------------------------------------------------------


def _mapped(rows: DataFrame, source: str, drop: tuple[str, ...], added: list[tuple[str, str]], step) -> DataFrame:
    """``rows`` without ``drop``, plus the columns that ``step`` makes of slices of ``source``."""
    ship_package(rows.sparkSession)
    keep = [c for c in rows.columns if c not in drop and c not in dict(added)]
    # Positions stand for the columns, whose names may clash with anything.
    inner = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), source_column(rows, source).alias("body"))
    names = [*(f"c{i}" for i in range(len(keep))), *(f"c{len(keep) + i}" for i in range(len(added)))]

    def run(batches):
        ready = step()
        for batch in batches:
            for lo, hi, columns in ready(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *columns], names)

    kinds = [inner.schema[i].dataType.simpleString() for i in range(len(keep))] + [kind for _, kind in added]
    out = inner.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return out.toDF(*keep, *(n for n, _ in added))


def source_column(rows: DataFrame, source: str):
    column = F.col(f"`{source}`")
    return column.cast("string") if rows.schema[source].dataType.simpleString() != "array<int>" else column


def encode_documents(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` without its text, plus ``ids``, ``n_tokens`` and, if wanted, ``decoded``,
    which the same task makes of the ids."""
    path = tokenizer or default_tokenizer()

    def step():
        encoder = warm(WordBpe, path)
        table = spell(encoder.tokens)

        def ready(texts):
            for lo, hi, data, offsets in words.chunks(texts, CHUNK_BYTES):
                ids, count = encoder(data, offsets)
                at = pa.array(np.append(0, count.cumsum()).astype(np.int32))
                columns = [pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))), pa.array(count)]
                yield lo, hi, columns + ([_texts(*decode(table, ids, count))] if decoded else [])

        return ready

    added = [("ids", "array<int>"), ("n_tokens", "bigint"), *([("decoded", "string")] if decoded else [])]
    return _mapped(docs, text_col, (text_col,), added, step)


def _texts(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes()))


def decode_documents(rows: DataFrame, ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``rows`` plus ``decoded``. Ids outside the vocabulary are left out."""
    path = tokenizer or default_tokenizer()

    def step():
        table = spell(tokens_of(path))

        def ready(lists):
            n, at = len(lists), 0
            while at < n:
                # Lists are taken together while their ids are few enough.
                offsets = lists.offsets.to_numpy()[at:].astype(np.int64)
                end = at + max(1, int(np.searchsorted(offsets, offsets[0] + (CHUNK_BYTES >> 2), "right")) - 1)
                part = lists.slice(at, end - at)
                ids, count = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_value_length(part).fill_null(0).to_numpy().astype(np.int64)
                raw, places = decode(table, ids, count)
                gone = part.is_null()
                yield at, end, [pa.compute.if_else(gone, pa.scalar(None, pa.string()), _texts(raw, places))]
                at = end

        return ready

    return _mapped(rows.withColumns({ids_col: F.col(f"`{ids_col}`").cast("array<int>")}), ids_col, (), [("decoded", "string")], step)


def digests(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the number of ids and SHA-256 digests of the ids, as decimals joined by spaces, and of the decoded text."""
    return rows.select(
        *keep, "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
