"""Helpers that the training-data operators share. materialise() writes a table to the shared folder and reads it back."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.storage import written as materialise


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_texts(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose text or binary column holds about most_bytes, or a single row that is larger: what a
    worker holds at a time doesn't grow with the rows a batch has."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        number = np.cumsum(sizes) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), n]
        for first, end in zip(edges, edges[1:], strict=False):
            if end > first:
                yield batch.slice(first, end - first)


ROWS_TO_PYTHON = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _freed() -> None:
    """Give memory that a worker no longer uses back to the system: workers wait for their next task for a minute."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def on_texts(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, most: int = 1000) -> DataFrame:
    """df.mapInArrow(run, schema) for rows with whole texts: batches have at most `most` rows from now on in this session, as
    both the executor and its Python workers hold a batch as a whole, and a worker gives its memory back after a task."""
    now = int(df.sparkSession.conf.get(ROWS_TO_PYTHON))
    if now <= 0 or now > most:
        df.sparkSession.conf.set(ROWS_TO_PYTHON, str(most))

    def guarded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _freed()

    return df.mapInArrow(guarded, schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """MurmurHash3's 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def join_by_frequency(df: DataFrame, lookup: DataFrame, key: str, share: int = 2000) -> DataFrame:
    """df left-joined with a lookup that has one row a key, without a task for each hot key.

    At most `share` keys can hold more than 1/share of df's rows; their lookup rows are broadcast. All others are joined
    by a shuffle. df and lookup are read more than once, so both should be written tables.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    least = df.count() / share
    hot = F.broadcast(counts.where((F.col("_n") > least) & (F.col("_n") > 1)).select(key))
    heavy = F.broadcast(lookup.join(hot, key, "left_semi"))
    often = df.join(hot, key, "left_semi").join(heavy, key, "left")
    rest = df.join(hot, key, "left_anti").join(lookup, key, "left")
    return often.unionByName(rest)


def text_key(text_col: str) -> Column:
    """A digest that stands for the text; null for null."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def drop_rows(docs: DataFrame, gone: DataFrame, keys: list[Column], most: int = 500_000) -> DataFrame:
    """docs without the rows whose keys are a row of `gone` (its columns in the order of the keys; null matches null).

    Up to `most` rows are broadcast, so that texts aren't shuffled; more are joined by a shuffle.
    """
    gone = materialise(gone.toDF(*(f"_gone{k}" for k in range(len(keys)))).distinct(), "gone")
    few = gone.limit(most + 1).count() <= most
    same = [key.eqNullSafe(F.col(f"_gone{k}")) for k, key in enumerate(keys)]
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
