"""Near duplicates by SimHash, linked with meet-in-the-middle ball hashing.

Fingerprints are linked when they differ in at most four bits. Split the 64 bits
into three blocks: whatever the differing bits are, some block holds at least
two of them when there are four (and at least as many as any other block
otherwise), so the other two blocks differ in at most two bits. Leave out each
block in turn; two linked fingerprints then lie within radius two on the kept
bits of one of the three choices, and meet in the middle: each emits all
variants within radius one of its kept bits (about 44 per choice, 132 in all,
against 2,081 variants for radius two on all 64 bits), the variants are shuffled,
and fingerprints that collide are verified on all 64 bits.

A variant that more than ``BUCKET_LIMIT`` fingerprints share is not paired up.
Its fingerprints go through the plain form instead: every variant within radius
two of the whole fingerprint. All that share such a variant are within four bits
of each other, so linking each to the smallest is exact and needs no pairs. Every
fingerprint of a large variant takes this way, so no link is lost.

Only distinct fingerprints take part, with the smallest document id of each, so
copies cost nothing. Components come from alternating large-star and small-star
steps, each written to the shared folder.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of four
words with repeats, joined by one space; fewer words: the whole sequence; none
(empty or null text): fingerprint zero, linked like any other. A bit is set if
it is set in more than half of the shingle hashes (XXH64 of UTF-8, seed 42).
Null ids are kept, and are a component id only where no member has an id. Equal
rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from furrow.session import checkpointed, ship_package

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = ((0, 22), (22, 43), (43, 64))  # bit ranges left out in turn
BUCKET_LIMIT = 1024  # more fingerprints at one variant take the plain form
SLICE = 4096  # fingerprints expanded at a time


# --- fingerprints ----------------------------------------------------------------------


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bitwise majority of runs of hashes; runs may be empty (zero)."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if not full.any():
        return out
    votes = np.zeros((int(full.sum()), 64), np.int64)
    for byte in range(8):
        part = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
        bits = np.unpackbits(part[:, None], axis=1, bitorder="little")
        votes[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int64)
    bits = (2 * votes > counts[full, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_texts(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text, a bounded number of shingles at a time."""
    out, held, total, first = [], [], 0, 0

    def flush():
        counts = np.array([len(h) for h in held], np.int64)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        out.append(majority(np.concatenate(held), starts, counts))

    for text in texts:
        held.append(shingle_hashes(text))
        total += len(held[-1])
        if total > 1 << 17:
            flush()
            held, total = [], 0
    if held:
        flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


ROWS_AT_ONCE = 500


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            # A batch may hold much text; its words are taken apart for some rows at a time.
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                fps = fingerprint_texts([t or b"" for t in part.column("text").to_pylist()]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


# --- links -----------------------------------------------------------------------------


def block_masks() -> list[int]:
    """For each choice of a block, the bits that stay."""
    whole = (1 << 64) - 1
    return [whole ^ ((1 << hi) - (1 << lo)) for lo, hi in BLOCKS]


def masked_variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variants, positions of their fingerprints): radius one on the kept bits
    of each choice. The free block of a variant carries the choice's number."""
    keys, owners = [], []
    rows = np.arange(len(fps))
    for number, (mask, (lo, _)) in enumerate(zip(block_masks(), BLOCKS)):
        kept = fps & np.uint64(mask)
        flips = np.array([0] + [1 << b for b in range(64) if mask >> b & 1], np.uint64)
        keys.append(((kept[:, None] ^ flips[None, :]) | np.uint64(number << lo)).ravel())
        owners.append(np.repeat(rows, len(flips)))
    return np.concatenate(keys), np.concatenate(owners)


def whole_variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain form: all variants within half the radius of all 64 bits."""
    one = [1 << b for b in range(64)]
    two = [one[a] | one[b] for a in range(64) for b in range(a)]
    flips = np.array([0] + one + two, np.uint64)
    return (fps[:, None] ^ flips[None, :]).ravel(), np.repeat(np.arange(len(fps)), len(flips))


def _expand(fps: DataFrame, variants) -> DataFrame:
    """``variant, fp`` rows of a table of fingerprints."""

    step = SLICE if variants is masked_variants else SLICE // 16

    def run(batches):
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(every), step):
                part = every[at : at + step]
                keys, owner = variants(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(part[owner].view(np.int64))], ["variant", "fp"]
                )

    return fps.select("fp").mapInArrow(run, "variant bigint, fp bigint")


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a small set under the link rule."""
    edges: list[tuple[int, int]] = []
    free = np.arange(len(members))
    while len(free):
        stack, free = [int(free[0])], free[1:]
        while stack and len(free):
            at = stack.pop()
            near = np.bitwise_count(members[free] ^ members[at]) <= RADIUS
            reached = free[near].tolist()
            edges += [(at, x) for x in reached]
            stack += reached
            free = free[~near]
    return edges


def _runs(batches) -> Iterator[tuple[np.ndarray, bool]]:
    """Runs of two or more fingerprints at one variant, from rows sorted by
    variant. A run over the limit comes in pieces marked True; no more than a
    batch and the limit are held."""
    tail_key, tail, large = None, np.zeros(0, np.int64), False
    for batch in batches:
        keys, fps = batch.column("variant").to_numpy(), batch.column("fp").to_numpy()
        if not len(keys):
            continue
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        for i in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys))).tolist():
            key, part = keys[starts[i]], fps[starts[i] : ends[i]]
            if key == tail_key:
                part = np.concatenate((tail, part))
            else:
                if len(tail) > 1 or (large and len(tail)):
                    yield tail, large
                large = False
            tail_key, tail = key, part
            if len(tail) > BUCKET_LIMIT or large:
                large = True
                yield tail, True
                tail = np.zeros(0, np.int64)
    if len(tail) > 1 or (large and len(tail)):
        yield tail, large


def _collide(batches):
    """``a, b``: tree links of small variants, and ``b`` null for every
    fingerprint of a large one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    left, right = [], []
    for members, large in _runs(batches):
        if large:
            left += members.tolist()
            right += [None] * len(members)
        else:
            for i, j in forest(members.view(np.uint64)):
                left.append(int(members[i]))
                right.append(int(members[j]))
        if len(left) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": left, "b": right}, schema)
            left, right = [], []
    yield pa.RecordBatch.from_pydict({"a": left, "b": right}, schema)


def links(fps: DataFrame) -> DataFrame:
    """``a, b`` fingerprint pairs at most four bits apart whose components are
    those of all such pairs. ``fps`` holds distinct fingerprints."""
    spark = fps.sparkSession
    ship_package(spark)
    # Spread first: expanding 132-fold deserves every core.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _expand(fps.repartition(parts, "fp"), masked_variants)
    sorted_rows = rows.repartition(parts, "variant").sortWithinPartitions("variant")
    found = checkpointed(sorted_rows.mapInArrow(_collide, "a bigint, b bigint").distinct(), spark, "simhash-links")
    crowded = found.where("b is null").select(F.col("a").alias("fp"))
    stars = (
        _expand(crowded.repartition(parts, "fp"), whole_variants)
        .groupBy("variant")
        .agg(F.collect_set("fp").alias("fps"))  # at most 2,081: the fingerprints within two bits of one value
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a < b")
    )
    return found.where("b is not null").union(stars).distinct()


# --- components ------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges; the root is the smallest node.

    Alternates large-star and small-star steps until no edge changes; the number
    of steps grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    now = checkpointed(edges.select("a", "b").where("a <> b").distinct(), spark, "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").where("x <> m")
        now = checkpointed(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), spark, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = tuple(seen)
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    spark = docs.sparkSession
    marked = checkpointed(fingerprints(docs, id_col, text_col), spark, "fingerprints")
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), spark, "distinct-fingerprints")
    roots = checkpointed(components(links(distinct)), spark, "roots")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(ids, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row per component: the smallest id, and of
    equal ids one. Columns stay as they are; rows with a null id stay only where
    no member of their component has an id."""
    tag = "_furrow_row"
    spark = docs.sparkSession
    # The row number is stored with the rows, so both reads agree on it.
    rows = checkpointed(docs.withColumn(tag, F.monotonically_increasing_id()), spark, "dedup-rows")
    marked = checkpointed(fingerprints(rows, tag, text_col).withColumnRenamed("doc_id", tag), spark, "fingerprints")
    ids = rows.select(tag, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(tag).alias("row")).alias("who"))
    owned = marked.join(ids, tag)
    distinct = checkpointed(owned.groupBy("fp").agg(F.min("who").alias("who")), spark, "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("who", F.coalesce("root", "fp").alias("root"))
    chosen = named.groupBy("root").agg(F.min("who").alias("who")).select(F.col("who.row").alias(tag))
    return rows.join(chosen, tag, "left_semi").select(*docs.columns)


def with_fingerprint_text(found: DataFrame) -> DataFrame:
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
