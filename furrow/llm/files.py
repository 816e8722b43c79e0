"""Files that tasks write beside Spark's own tables.

A task writes under names that carry its attempt number and reports them in its
output rows; the rows are kept by Spark's own commit, so files of a lost or
repeated attempt are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (``file:``, ``hdfs:``, ``s3:`` ...) or plain path."""
    return fs.FileSystem.from_uri(uri)


def attempt_name() -> str:
    ctx = TaskContext.get()
    return f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}" if ctx else "000000-0"


def write_bytes(folder: str, name: str, data: bytes | memoryview) -> str:
    """Write one new file below ``folder`` and return its URI."""
    system, base = resolve(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(data)
    return f"{folder.rstrip('/')}/{name}"


@contextmanager
def open_ranges(uri: str) -> Iterator:
    """A random-access handle with ``size()`` and ``read_at(length, offset)``."""
    system, path = resolve(uri)
    handle = system.open_input_file(path)
    try:
        yield handle
    finally:
        handle.close()
