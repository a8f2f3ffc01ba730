"""Helpers shared by the operators: reading a table, naming a written step, batching long texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotopic.session import written  # noqa: F401 (the operators take it from here)

BLOCK_BYTES = 1 << 20  # texts handled together inside a task: about this many characters
BLOCK_ROWS = 256  # rows of a batch turned into Python values at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; read by Spark, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc32_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % n


def text_blocks(ids: list, texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """Slices of a batch holding about ``limit`` characters, at least one text each; null is ""."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > a and size + n > limit:
            yield ids[a:i], [x or "" for x in texts[a:i]]
            a, size = i, 0
        size += n
    if a < len(texts):
        yield ids[a:], [x or "" for x in texts[a:]]


def give_back() -> None:
    """Hand freed memory of this Python worker back to the system: Spark keeps idle workers for later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def giving_back(run: Callable) -> Callable:
    """The iterator function ``run``; when a task's rows end, or it is stopped, the worker gives memory back."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def per_block(fn: Callable, schema, *key: str, text: str = "text"):
    """A ``mapInArrow`` function from ``fn(ids, texts) -> dict of columns``.

    Key columns come first in the input, the text last. Each slice of about ``BLOCK_BYTES``
    characters is handled on its own, so memory does not follow Spark's batch size.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(a, BLOCK_ROWS)
                keys = list(zip(*[rows.column(k).to_pylist() for k in key]))
                for ids, texts in text_blocks(keys, rows.column(text).to_pylist()):
                    yield pa.RecordBatch.from_pydict(fn(ids, texts), schema=schema)
    return giving_back(run)
