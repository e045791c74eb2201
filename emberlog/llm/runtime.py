"""Shared helpers: the session's settings, workers' memory, the package on executors, and fixed vocabularies."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberlog import shared
from emberlog.shared import clean_up, fresh_path, materialize, shared_dir

__all__ = ["clean_up", "crc32_of_id", "fresh_path", "grouped", "materialize", "paired", "release", "shared_dir", "ship", "streamed", "tokenizer_path"]

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java regex class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes that a batch of rows on its way to Python holds (a row alone may be larger). Set in a session that does not say otherwise.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give memory that is free within this process back to the system. Workers live on from task to task, two or more on an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def streamed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``f`` for mapInArrow, with ``release`` after each task."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def grouped(f: Callable[[pa.Table], pa.Table]):
    """``f`` for applyInArrow, with ``release`` after each group."""

    def run(table):
        out = f(table)
        release()
        return out

    return run


def paired(f: Callable[[pa.Table, pa.Table], pa.Table]):
    """The same for two tables of a cogroup."""

    def run(left, right):
        out = f(left, right)
        release()
        return out

    return run


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: in the folder that EMBERLOG_TOKENIZERS names, in /opt/tokenizers, or where its package says."""
    path = os.path.join(os.environ.get("EMBERLOG_TOKENIZERS", "/opt/tokenizers"), name)
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and bound the session's batches."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    shared.ship(spark)
