"""Alignment of two tokenizers' ids over the same texts.

Both tokenizers encode a space and the text. Byte offsets where tokens of both end cut
the text into groups, found by divide and conquer: in a stretch of tokens a common end
near the middle is looked for, by bisecting the other side's ends for the ends next to
the middle, outwards; both halves go on in the same way, and a stretch without such a
cut is a group. All stretches of a block of texts take a step together, as numpy rows.
A stretch with one token on either side has no inner end and is a group at once.

Tokens of different sides whose byte ranges lie in one group are linked. The links of a
document are kept as distinct id pairs with their multiplicity; in large groups equal
ids are counted before they are paired. How many documents link a pair is counted per
block of texts first, so a pair moves once per block, not once per document, and no
pair holds more rows of a shuffle than there are blocks. The counts come back to each
block by the same way, and its documents meet them there; neither the vocabulary nor
the pairs pass through the driver or a broadcast.

Texts that are null or empty, or that either tokenizer does not give back byte by byte
(such as one that holds the word mark itself), have no tokens: their numbers are zero
and their groups empty. Rows are kept one for one, repeated ones too; an empty table
gives no rows. Columns named like the result's are replaced; the text is not returned.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from furrow.llm import words
from furrow.llm.tokens import PartEncoder, TextEncoder, default_tokenizer, warm
from furrow.session import checkpointed, ship_package

BLOCK_BYTES = 4 << 20  # texts whose links are counted together
CHUNK_BYTES = 1 << 20  # texts encoded together
PAIRED = 1 << 12  # pairs of tokens from which on equal ids of a group are counted first
SPACE = 32

#: ``groups`` lists decimal ids: those of one side by commas, a bar between the sides,
#: groups by semicolons, as in ``a1,a2|b1;a3|b2,b3``; ``parsed_groups`` gives arrays.
RESULT = [("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups", "string")]
#: Where a row's links are counted: its block, its distinct pairs as places in the
#: block's list of pairs, and their multiplicity. A block's first row holds that list.
LINKS = [("block", "bigint"), ("pair_at", "array<int>"), ("pair_times", "array<int>"), ("block_a", "array<int>"), ("block_b", "array<int>"), ("block_docs", "array<int>")]


# --- tokens ----------------------------------------------------------------------------


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder(PartEncoder):
    """Ids by a SentencePiece model of texts that begin with a space. No piece of the
    model holds a space behind another character, so texts are cut there."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} holds a space inside")
            self.spelled.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        super().__init__(np.array([len(s) for s in self.spelled], np.int64))

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(data), bool)
        space = data == SPACE
        mark[1:] = space[1:] & ~space[:-1]
        mark[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(mark)

    def joins(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return data[end - 1] != SPACE

    def run(self, texts: list[bytes]) -> list[np.ndarray]:
        # The model puts the leading space back, but not before an empty text.
        found = self.model.encode([t[1:].decode("utf-8", "replace") for t in texts], num_threads=1)
        alone = [self.model.piece_to_id("▁")]
        return [np.array(ids if len(text) > 1 else alone, np.int32) for text, ids in zip(texts, found)]


class ByteEncoder(TextEncoder):
    """Ids by a byte-level model; special-token strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path, special=False)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.spelled = [b""] * len(self.width)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.spelled[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()


class Spelling:
    """The bytes of tokens."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.first = self.size.cumsum() - self.size
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)

    def same(self, ids: np.ndarray, count: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text, joined, are its bytes."""
        size = self.size[ids]
        ends = np.append(0, size.cumsum())
        at = ends[np.append(0, count.cumsum())]
        length = np.diff(offsets)
        good = np.diff(at) == length
        if not good.all():  # keep only texts of the right length in step
            inside = np.repeat(good, count)
            ids, size = ids[inside], size[inside]
            ends = np.append(0, size.cumsum())
            data = data[np.repeat(good, length)]
        raw = self.pool[np.repeat(self.first[ids] - ends[:-1], size) + np.arange(len(data))]
        wrong = np.flatnonzero(raw != data)
        bounds = np.append(0, np.where(good, length, 0).cumsum())
        good[np.searchsorted(bounds, wrong, "right") - 1] = False
        return good


# --- groups and links ------------------------------------------------------------------


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side that end a group, as masks. ``ends`` are byte offsets,
    rising over all texts; text ``i`` has tokens ``first[i]`` to ``first[i + 1]``."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    filled = np.flatnonzero(np.diff(first_a) > 0)
    lo_a, hi_a, lo_b, hi_b = first_a[filled], first_a[filled + 1] - 1, first_b[filled], first_b[filled + 1] - 1
    cut_a[hi_a], cut_b[hi_b] = True, True
    while True:
        # A stretch is its first and last token of either side; the last tokens end it.
        wide = (hi_a > lo_a) & (hi_b > lo_b)
        lo_a, hi_a, lo_b, hi_b = (x[wide] for x in (lo_a, hi_a, lo_b, hi_b))
        if not len(lo_a):
            return cut_a, cut_b
        mid_a = (lo_a + hi_a - 1) >> 1
        mid_b = np.full(len(lo_a), -1)
        open_ = np.arange(len(lo_a))
        middle, step = mid_a.copy(), 0
        while len(open_):
            at = middle[open_] + step
            valid = (at >= lo_a[open_]) & (at < hi_a[open_])
            tried, at = open_[valid], at[valid]
            end = ends_a[at]
            place = np.searchsorted(ends_b, end)
            hit = ends_b[place] == end
            mid_a[tried[hit]], mid_b[tried[hit]] = at[hit], place[hit]
            step = 1 - step if step <= 0 else -step  # 0, 1, -1, 2, -2 ...
            reach = middle[open_] + (step if step > 0 else 0)
            # Going on makes sense while either side has ends left at this distance.
            left = (mid_b[open_] < 0) & ((reach < hi_a[open_]) | (middle[open_] - abs(step) >= lo_a[open_]))
            open_ = open_[left]
        found = mid_b >= 0
        mid_a, mid_b = mid_a[found], mid_b[found]
        cut_a[mid_a], cut_b[mid_b] = True, True
        lo_a, hi_a, lo_b, hi_b = lo_a[found], hi_a[found], lo_b[found], hi_b[found]
        lo_a, hi_a = np.concatenate((lo_a, mid_a + 1)), np.concatenate((mid_a, hi_a))
        lo_b, hi_b = np.concatenate((lo_b, mid_b + 1)), np.concatenate((mid_b, hi_b))


def linked_pairs(ids_a, ids_b, at_a, at_b, text, kinds_b: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``text * kinds + a * kinds_b + b`` of linked tokens, in order, and how many links each stands for.
    Group ``g`` has tokens ``at[g]`` to ``at[g + 1]`` of either side and lies in ``text[g]``."""
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    product = n_a * n_b
    small = np.flatnonzero(product <= PAIRED)
    each = product[small]
    inside = np.arange(int(each.sum())) - np.repeat(each.cumsum() - each, each)
    width = np.repeat(n_b[small], each)
    a = ids_a[np.repeat(at_a[small], each) + inside // width].astype(np.int64)
    b = ids_b[np.repeat(at_b[small], each) + inside % width].astype(np.int64)
    keys, times = [np.repeat(text[small], each) * kinds + a * kinds_b + b], [np.ones(len(a), np.int64)]
    for g in np.flatnonzero(product > PAIRED).tolist():
        a, many_a = np.unique(ids_a[at_a[g] : at_a[g + 1]], return_counts=True)
        b, many_b = np.unique(ids_b[at_b[g] : at_b[g + 1]], return_counts=True)
        keys.append((text[g] * kinds + a.astype(np.int64)[:, None] * kinds_b + b).ravel())
        times.append((many_a[:, None] * many_b).ravel())
    key, time = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(time[order], first) if len(key) else time


class Aligner:
    def __init__(self, tokenizer: str, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoders = ByteEncoder(tokenizer), PieceEncoder(model)
        self.spellings = [Spelling(e.spelled) for e in self.encoders]
        sizes = [len(s.size) for s in self.spellings]
        self.kinds_b, self.kinds = sizes[1], sizes[0] * sizes[1]
        self.digits = Spelling([str(i).encode() for i in range(max(sizes))])

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids per text) of either side; texts that one side does not give back have none."""
        length = np.diff(offsets)
        lead = offsets[:-1][length > 0]
        spaced = np.insert(data, lead, SPACE)
        at = np.append(0, (length + (length > 0)).cumsum())
        sides = [encoder(spaced, at) for encoder in self.encoders]
        good = np.logical_and.reduce([s.same(ids, count, spaced, at) for s, (ids, count) in zip(self.spellings, sides)])
        return [(ids[np.repeat(good, count)], np.where(good, count, 0)) for ids, count in sides]

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: ids of either side, groups, links, bytes of the groups' text; then all of that text, pair keys and multiplicities."""
        n = len(offsets) - 1
        (ids_a, count_a), (ids_b, count_b) = self.tokens(data, offsets)
        first_a, first_b = np.append(0, count_a.cumsum()), np.append(0, count_b.cumsum())
        ends = [s.size[ids].cumsum() for s, ids in zip(self.spellings, (ids_a, ids_b))]
        at_a, at_b = (np.append(0, np.flatnonzero(cut) + 1) for cut in common_cuts(*ends, first_a, first_b))
        text = np.searchsorted(first_a, at_a[:-1], "right") - 1
        n_groups = np.bincount(text, minlength=n)
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, text, np.diff(at_a) * np.diff(at_b))
        written, length = self.written(ids_a, ids_b, at_a, at_b, n_groups)
        key, times = linked_pairs(ids_a, ids_b, at_a, at_b, text, self.kinds_b, self.kinds)
        return count_a, count_b, n_groups, n_links, length, written, key, times

    def written(self, ids_a, ids_b, at_a, at_b, n_groups) -> tuple[np.ndarray, np.ndarray]:
        """(the texts that list the groups, bytes of each)."""
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)  # behind every id
        ids[np.arange(len(ids_a)) + np.repeat(at_b[:-1], np.diff(at_a))] = ids_a
        ids[np.arange(len(ids_b)) + np.repeat(at_a[1:], np.diff(at_b))] = ids_b
        mark[at_a[1:] + at_b[:-1] - 1] = ord("|")
        mark[at_a[1:] + at_b[1:] - 1] = ord(";")
        size = self.digits.size[ids] + 1
        ends = np.append(0, size.cumsum())
        out = self.digits.pool[np.minimum(np.repeat(self.digits.first[ids] - ends[:-1], size) + np.arange(int(ends[-1])), len(self.digits.pool) - 1)]
        out[ends[1:] - 1] = mark
        reached = ends[(at_a + at_b)[np.append(0, n_groups.cumsum())]]
        filled = n_groups > 0
        return np.delete(out, reached[1:][filled] - 1), np.diff(reached) - filled

    def __call__(self, data: np.ndarray, offsets: np.ndarray, block: int) -> list[pa.Array]:
        """The columns of RESULT and LINKS for the texts of one block."""
        parts, at, n = [], 0, len(offsets) - 1
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            *columns, key, times = self.chunk(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            parts.append((*columns, key + at * self.kinds, times))
            at = end
        count_a, count_b, n_groups, n_links, length, written, key, times = (np.concatenate(x) for x in zip(*parts))
        pairs, place, docs = np.unique(key % self.kinds, return_inverse=True, return_counts=True)
        ints = lambda x: pa.array(x.astype(np.int32))
        lists = lambda at, x: pa.ListArray.from_arrays(ints(at), ints(x))
        bounds = np.searchsorted(key, np.arange(n + 1) * self.kinds)
        once = np.append(0, np.full(n, len(pairs)))  # the block's first row holds its pairs
        return [
            pa.array(count_a), pa.array(count_b), pa.array(n_groups), pa.array(n_links),
            pa.StringArray.from_buffers(n, pa.py_buffer(np.append(0, length.cumsum()).astype(np.int32)), pa.py_buffer(written.tobytes())),
            pa.array(np.full(n, block)), lists(bounds, place), lists(bounds, times),
            *(lists(once, x) for x in (pairs // self.kinds_b, pairs % self.kinds_b, docs)),
        ]


# --- Spark jobs ------------------------------------------------------------------------


def align(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """``docs`` without its text, plus the columns of RESULT and LINKS.

    Block numbers depend on how the input is split, so store the rows (``checkpointed``)
    before ``pair_documents`` or ``with_link_counts`` read them.
    """
    ship_package(docs.sparkSession)
    paths = tokenizer or default_tokenizer(), model or default_model()
    added = RESULT + LINKS
    keep = [c for c in docs.columns if c not in dict(added) and c != text_col]
    # Positions stand for the columns, whose names may clash with anything.
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("body"))
    names = [f"c{i}" for i in range(len(keep) + len(added))]

    def run(batches):
        aligner, block = warm(Aligner, *paths), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, offsets in words.chunks(batch.column(len(keep)), BLOCK_BYTES):
                columns = aligner(data, offsets, block)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *columns], names)
                block += 1

    kinds = [rows.schema[i].dataType.simpleString() for i in range(len(keep))] + [kind for _, kind in added]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).toDF(*keep, *dict(added))


def _block_pairs(aligned: DataFrame) -> DataFrame:
    """One row per block and pair: ``block, at, a, b, docs``."""
    zipped = F.arrays_zip(F.col("block_a").alias("a"), F.col("block_b").alias("b"), F.col("block_docs").alias("docs"))
    rows = aligned.where(F.size("block_a") > 0).select("block", F.posexplode(zipped).alias("at", "pair"))
    return rows.select("block", "at", "pair.a", "pair.b", "pair.docs")


def pair_documents(aligned: DataFrame) -> DataFrame:
    """How many documents link each id pair: ``a, b, documents``."""
    return _block_pairs(aligned).groupBy("a", "b").agg(F.sum("docs").alias("documents"))


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """Stored rows of ``align``, with ``n_best`` (links whose pair has the highest count
    among the pairs of its ``a``) and ``count_sum`` (counts summed over links) in place of LINKS.

    One group of the join is a block of at most BLOCK_BYTES of texts, or one longer text.
    """
    ship_package(aligned.sparkSession)
    keep = [c for c in aligned.columns if c not in dict(LINKS) and c not in ("n_best", "count_sum")]
    counts = pair_documents(aligned)
    counts = counts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))
    scored = _block_pairs(aligned).select("block", "at", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("home"), "at", "documents", "best")
    rows = aligned.select("block", "pair_at", "pair_times", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    names = [f"c{i}" for i in range(len(keep) + 2)]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        at, documents, best = (right.column(c).to_numpy() for c in ("at", "documents", "best"))
        size = int(at.max(initial=-1)) + 1
        value, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
        value[at], top[at] = documents, best
        left = left.combine_chunks()
        lists = left.column("pair_at").combine_chunks()
        place = lists.flatten().to_numpy().astype(np.int64)
        times = left.column("pair_times").combine_chunks().flatten().to_numpy().astype(np.int64)
        bounds = np.append(0, pa.compute.list_value_length(lists).to_numpy().cumsum())
        sums = [np.diff(np.append(0, (times * x[place]).cumsum())[bounds]) for x in (top, value)]
        return pa.Table.from_arrays([*left.columns[3:], *(pa.array(s) for s in sums)], names)

    kinds = [rows.schema[3 + i].dataType.simpleString() for i in range(len(keep))] + ["bigint", "bigint"]
    grouped = rows.groupBy("block").cogroup(scored.groupBy("home"))
    return grouped.applyInArrow(score, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).toDF(*keep, "n_best", "count_sum")


def parsed_groups(groups) -> F.Column:
    """The groups as ``array<struct<a:array<int>,b:array<int>>>``."""
    ids = lambda side: F.split(side, ",").cast("array<int>")
    parts = F.transform(F.filter(F.split(groups, ";"), lambda g: g != ""), lambda g: F.split(g, "[|]"))
    return F.transform(parts, lambda p: F.struct(ids(F.get(p, F.lit(0))).alias("a"), ids(F.get(p, F.lit(1))).alias("b")))


def digests(docs: DataFrame, *keep: str) -> DataFrame:
    """Align the texts, keep the digest of the groups and count the links over all documents."""
    rows = align(docs.select(*keep, "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    short = rows.select(*keep, "n_a", "n_b", "n_groups", "n_links", digest, *dict(LINKS))
    return with_link_counts(checkpointed(short, docs.sparkSession, "aligned"))
