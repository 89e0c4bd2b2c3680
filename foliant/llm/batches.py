"""Arrow batches of (key, text) rows, cut into slices of bounded size before Python works on them."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_CHARS = 2_000_000


def give_back() -> None:
    """Return what this worker has freed to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def cut(batch: pa.RecordBatch, sizes: list[int | None], most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose ``sizes`` come to ``most`` at most, one row at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(batch):
        yield batch.slice(start)


def text_slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of at most ``most`` characters, one row at least; the column ``text`` as Python strings, null as empty."""
    for batch in batches:
        for part in cut(batch, batch.column("n").to_pylist(), most):
            yield part, [x or "" for x in part.column("text").to_pylist()]


def byte_slices(batches: Iterable[pa.RecordBatch], column: str | int, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes in a string or binary column, one row at least."""
    for batch in batches:
        yield from cut(batch, pc.binary_length(batch.column(column)).to_pylist(), most)


def whole_rows(docs: DataFrame, text_col: str, work: Callable, most: int = SLICE_CHARS) -> DataFrame:
    """``work(part, texts)`` on bounded slices of whole rows, for steps that keep the columns of ``docs``; null texts come as empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        for part in byte_slices(batches, at, most):
            yield work(part, [x or "" for x in part.column(at).to_pylist()])
        give_back()

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def by_text(docs: DataFrame, keys: dict[str, Column | str], text: Column | str, work: Callable, schema: str, most: int = SLICE_CHARS) -> DataFrame:
    """``work(part, texts)`` on bounded slices of ``docs``; only the named columns are read, so further columns can't clash."""
    source = docs.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in keys.items()], (F.col(text) if isinstance(text, str) else text).alias("text"))
    source = source.withColumn("n", F.coalesce(F.length("text"), F.lit(0)))

    def run(batches):
        for part, texts in text_slices(batches, most):
            out = work(part, texts)
            if out is not None:
                yield out
        give_back()

    return source.mapInArrow(run, schema)
