"""Reading Arrow batches of texts and building batches, for the operators that run in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value without a copy; nothing for null."""
    if pa.types.is_null(column.type):
        for _ in range(len(column)):
            yield np.zeros(0, np.uint8)
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = None if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield bytes_[offsets[i] : offsets[i + 1]] if valid is None or valid[i] else bytes_[:0]


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values end to end, and where each begins (and the end); null is empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most_bytes`` of text, or a single row that has more."""
    for batch in batches:
        _, places = laid_out(batch.column(column))
        total, begin = 0, 0
        for i, n in enumerate(np.diff(places).tolist()):
            if total and total + n > most_bytes:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


@cache
def malloc_trim() -> Callable[[int], int] | None:
    """The C library's own, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Returns to the system what this process has freed but holds on to: Arrow's pool and the C library's heap."""
    pa.default_memory_pool().release_unused()
    if trim := malloc_trim():
        trim(0)


def leaving_no_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving its memory back at its end: workers live on, and would hold the most that any stage so far took."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(leaving_no_memory(run), schema)
