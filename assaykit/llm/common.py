"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key filter. As rows of 64 bits it has at most ``2**(bits - 6)`` rows of 16 bytes, whatever the input.
FILTER_BITS = 22


def among(df: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS, others: bool = False) -> DataFrame:
    """``df`` without most rows whose ``column`` is not in the one column of ``keys``; no row that is in it goes.

    A hashed bit table of fixed size, broadcast, stands before a shuffled join, so that rows without a partner need not
    travel. With more keys than bits it lets everything pass; results never depend on it. ``others`` gives the rows
    that it holds back instead. A null is a key like any other.
    """
    at = F.xxhash64(F.col(keys.columns[0])).bitwiseAND((1 << bits) - 1)
    table = keys.select(F.shiftright(at, 6).alias("filter_slot"), F.expr("shiftleft(1L, 0)").alias("one"), at.bitwiseAND(63).cast("int").alias("bit"))
    table = table.groupBy("filter_slot").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("filter_bits"))
    own = F.xxhash64(F.col(column)).bitwiseAND((1 << bits) - 1)
    near = df.join(F.broadcast(table), F.shiftright(own, 6) == F.col("filter_slot"), "left" if others else "inner")
    hit = F.getbit("filter_bits", own.bitwiseAND(63).cast("int")) == 1
    return near.where(~F.coalesce(hit, F.lit(False)) if others else hit).select(*df.columns)


def trimmed(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel``, after which its worker gives memory back that it no longer uses; workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return run


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of about ``size`` for what is run within: a few of them at a time are all that a task holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, with underscores appended where ``df`` has such a column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose first ``keys`` columns, whole numbers, are equal; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        cuts = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key))
        at = 0
        for to in cuts.tolist():
            now = key[at].tolist()
            if held and now != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(at, to - at))
            last, at = now, to
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)
