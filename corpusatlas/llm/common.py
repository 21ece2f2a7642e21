"""What the corpus operators share: column idioms and portions of batches; tables are kept by corpusatlas.storage."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.storage import fresh_dir, keep

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


#: df written to the shared folder and read again: later stages restart from there when executors are lost.
materialise = keep
__all__ = ["SPACES", "UPPER", "ascii_lower", "cache", "free_name", "fresh_dir", "let", "map_arrow", "materialise", "only", "portions", "positions", "table", "window_hashes", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; lower() is exact and fast for pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, separators: str = SPACES) -> Column:
    """The pieces between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(hashes: Column, n: int) -> Column:
    """A hash of each window of n elements, in order of place: pairs of shorter windows, so log(n) passes."""

    def pairs(g: Column, step: int) -> Column:
        return F.transform(F.slice(g, 1, F.greatest(F.size(g) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(g, i + step)))

    def grow(g: Column, width: int) -> Column:
        if 2 * width <= n:
            return let(pairs(g, width), lambda wider: grow(wider, 2 * width))
        return pairs(g, n - width) if width < n else g

    return grow(hashes, 1)


def positions(n: Column) -> Column:
    """[0, n); empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def portions(batch, column: str = "text", rows: int = 512, most: int = 4 << 20) -> Iterator:
    """The batch in slices of at most `rows` rows and, but for single longer ones, `most` bytes in a text column."""
    import pyarrow.compute as pc

    if column in batch.schema.names:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    else:
        ends = np.zeros(batch.num_rows, np.int64)
    i = 0
    while i < batch.num_rows:
        done = int(ends[i - 1]) if i else 0
        j = min(i + rows, max(i + 1, int(np.searchsorted(ends, done + most, "right"))))
        yield batch.slice(i, j - i)
        i = j


#: Caches that modules keep in a worker from task to task.
CACHES: list[dict] = []


def cache(kept: dict) -> dict:
    CACHES.append(kept)
    return kept


def only(kept: dict | None = None) -> None:
    """A worker serves one operator after the other: the caches of others go, and freed memory goes back to the system."""
    import ctypes

    import pyarrow as pa

    for c in CACHES:
        if c is not kept:
            c.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has it on Linux
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, step: Callable, schema: str, rows: int = 512, most: int = 4 << 20, kept: Callable[[], dict] | None = None) -> DataFrame:
    """step over portions of record batches, so that what a worker derives from a batch stays bounded. kept: the cache
    that the step uses."""

    def run(batches: Iterator) -> Iterator:
        own = kept() if kept else None
        only(own)
        for batch in batches:
            for part in portions(batch, rows=rows, most=most):
                yield from step(part)
        only(own)

    return df.mapInArrow(run, schema)
