"""FeatureCollection files of any size, read by many tasks.

A file is cut into byte ranges. A feature belongs to the range its first byte is in,
so it appears once wherever the cuts fall. The task of a range looks for the first
object in it that is a feature; from there on features follow each other. An object
inside a feature (its geometry, its properties) is no feature, and a brace inside a
text opens no object, because the quotes after it are escaped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from furrow.session import ship_package

SPLIT_BYTES = 32 << 20
AHEAD_BYTES = 1 << 20
FIRST_AHEAD = 1 << 14  # read first past the end of a range, where its last feature ends; then twice as much each time
_HEAD = re.compile(rb'"features"\s*:\s*\[')
_GAP = re.compile(r"[\s,]*")
_decode = json.JSONDecoder().raw_decode


class _Window:
    """The text of a file from ``start`` on, as far as it has been read."""

    def __init__(self, handle, start: int, size: int):
        self.handle, self.end, self.size = handle, start, size
        self.raw = b""

    def grow(self, n: int) -> bool:
        n = min(n, self.size - self.end)
        self.raw += self.handle.read_at(n, self.end)
        self.end += n
        return n > 0

    def text(self) -> str:
        return self.raw.decode("utf-8", "replace")


def features_in(handle, size: int, start: int, end: int) -> Iterator[str]:
    """The text of every feature that begins at bytes ``start`` to ``end`` of a collection."""
    window = _Window(handle, start, size)
    window.grow(end - start)
    if start == 0:
        while not (head := _HEAD.search(window.raw)):
            if not window.grow(AHEAD_BYTES):
                raise ValueError("no list of features")
        window.raw, start = window.raw[head.end() :], head.end()
    else:  # a character cut in two belongs to the range before
        cut = next((i for i in range(min(4, len(window.raw))) if window.raw[i] & 0xC0 != 0x80), 0)
        window.raw, start = window.raw[cut:], start + cut
    text, at, synced = window.text(), 0, False
    done = 0  # characters of the text whose bytes are counted in ``start``
    ahead = FIRST_AHEAD
    while True:
        at = _GAP.match(text, at).end() if synced else text.find("{", at)
        if at < 0 or (not synced and start + len(text[done:at].encode()) >= end):
            return
        if at >= len(text):
            if window.end >= end or not window.grow(AHEAD_BYTES):  # what follows begins past the range
                return
            text = window.text()
            continue
        start, done = start + len(text[done:at].encode()), at
        if start >= end or (synced and text[at] != "{"):  # the list is over
            return
        try:
            found, stop = _decode(text, at)
        except json.JSONDecodeError as e:
            # An object that the text ends in may go on in the next bytes.
            if (synced or e.pos >= len(text) - 8 or e.msg.startswith("Unterminated")) and window.grow(ahead):
                window.raw = window.raw[start - (window.end - len(window.raw)) :]  # features already read are let go
                text, at, done, ahead = window.text(), 0, 0, ahead * 2
                continue
            if synced:
                raise ValueError(f"broken feature at byte {start}: {e.msg}") from None
            at += 1
            continue
        if isinstance(found, dict) and found.get("type") == "Feature":
            yield text[at:stop]
            at, synced = stop, True
        elif synced:
            raise ValueError(f"no feature at byte {start}")
        else:
            at += 1


def read_features(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``value``: the JSON text of every feature of the collections under ``path``."""
    ship_package(spark)
    listed = spark.read.format("binaryFile").load(path).select("path", "length")  # the content is not read
    ranges = listed.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = fs.FileSystem.from_uri(row["path"])
                held, size = [], 0
                with system.open_input_file(name) as handle:
                    for text in features_in(handle, row["length"], row["start"], min(row["start"] + split_bytes, row["length"])):
                        held.append(text)
                        size += len(text)
                        if size >= AHEAD_BYTES:
                            yield pa.RecordBatch.from_pydict({"value": held})
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict({"value": held})

    # Ranges are few and small rows; each is dealt to a task of its own where there are enough.
    return ranges.repartition(parts, "path", "start").mapInArrow(read, "value string")


def as_collections(lines: DataFrame) -> DataFrame:
    """Feature texts (``value``) as the lines of one collection per partition."""
    ship_package(lines.sparkSession)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = '{"type":"FeatureCollection","features":['
        for batch in batches:
            if batch.num_rows:
                held = batch.column("value").to_pylist()
                yield pa.RecordBatch.from_pydict({"value": [lead + held[0], *("," + v for v in held[1:])]})
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": [lead + "]}" if lead != "," else "]}"]})

    return lines.mapInArrow(wrap, "value string")
