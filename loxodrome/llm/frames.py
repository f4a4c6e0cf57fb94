"""Small helpers shared by the operators that run on Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows of one Arrow batch that are worked on at a time, by bytes of text; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch, where the session doesn't name a bound of its own.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_held: dict = {}


def resident(key: Hashable, make: Callable):
    """``make()``, kept for the tasks to come. A process keeps one such object: another one takes its place."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what :func:`resident` keeps, and give the memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
        _trim()


def _trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: what else a table carries never meets the operator's own names."""
    require(df, *columns)
    return df.select(*[df[c] for c in columns])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes. Unless ``run`` uses a resident object (``keeps``), workers drop theirs."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        yield from run(batches)
        _trim()

    return df.mapInArrow(settled, schema)


def per_slice(
    df: DataFrame, schema: str | StructType, text_col: str, make: Callable[[], Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch]], size: int = SLICE_BYTES, keeps: bool = False
) -> DataFrame:
    """``make()(rows, texts)`` for each run of rows with about ``size`` bytes of text, an output batch for each.

    ``make`` runs once a task; ``texts`` is the rows' text column, with empty texts for null.
    """
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work, at = work or make(), 0
            for part in slices(known_texts(batch.column(place)), size):
                yield work(batch.slice(at, len(part)), part)
                at += len(part)

    return map_batches(df, run, schema, keeps)


def known_texts(column: pa.Array) -> pa.Array:
    """A column of texts with empty ones for null; without nulls the column itself, not a copy."""
    return pc.fill_null(column, "") if column.null_count else column


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cut a column of texts into runs of about ``size`` bytes; a longer text makes a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def long_lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of lists; of large ones where 32-bit offsets wouldn't do."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if ends[-1] < 1 << 31:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat))


def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream; whoever sorts the stream bounds the runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and held[-1].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
