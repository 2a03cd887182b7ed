"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most; Spark's own 10,000 whole texts at once are too many.
ARROW_ROWS = 1000
#: Rows that a Python function takes from a batch at once.
SLICE_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a local session that names none gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = os.path.join(tempfile.gettempdir(), "checkpoints", "tidebook")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder. Only narrow rows go through here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let the driver forget what is done with.

    Shuffle files, broadcasts and checkpoints go once the driver's collector has seen that
    nothing refers to them, which an idle driver may put off for long; loops call this.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name in it clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(cols: list[str], row: str = "row") -> list[Column]:
    return [F.col(f"{row}.`{c}`").alias(c) for c in cols]


Batches = Iterator[pa.RecordBatch]


def in_slices(f: Callable[[Batches], Batches], rows: int = SLICE_ROWS) -> Callable[[Batches], Batches]:
    """``f`` over slices of its batches; afterwards the worker gives back the memory that it held, as it may idle for long."""

    @wraps(f)
    def run(batches: Batches) -> Batches:
        yield from f(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        give_back()

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python ``ARROW_ROWS`` rows at once at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def in_arrow(df: DataFrame, f: Callable[[Batches], Batches], schema, rows: int = SLICE_ROWS) -> DataFrame:
    """``df.mapInArrow`` with bounded batches (see ``ARROW_ROWS``) and slices."""
    small_batches(df.sparkSession)
    return df.mapInArrow(in_slices(f, rows), schema)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` in ``groups``, safe for hot keys.

    A key with more than ``n_rows / 1000`` rows (1,000 at least) counts as hot.
    There can be at most 1,000 of those, whatever the data, so they are
    broadcast and their rows never shuffle; all others are joined by a shuffle
    in which no key holds more than a thousandth of the rows.
    """
    limit = max(1000, n_rows // 1000)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    of_hot = rows.join(F.broadcast(hot), key, "inner")
    of_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "inner")
    return of_hot.unionByName(of_cold)
