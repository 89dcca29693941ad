"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The remainder of crc32(doc_id as text) modulo 3 whose labels are never learned from.
HELD_OUT = 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether the row belongs to the evaluation fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def text_bytes(text: Column) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


@functools.cache
def _libc():
    """The C library's allocator, told to give large arrays back as soon as they are freed; None where it is another one."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # from this size on a block is a mapping of its own
        libc.malloc_trim(0)
        return libc
    except (OSError, AttributeError):
        return None


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that leaves nothing behind: workers live on, and keep what they do not give back."""

    @functools.wraps(run)
    def lean(parts: Iterator) -> Iterator:
        libc = _libc()
        try:
            yield from run(parts)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return lean
