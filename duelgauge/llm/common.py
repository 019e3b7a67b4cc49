"""What the text operators share: tables, shipping of task code, hashing, packing rows into blocks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Java and Python both read this class as exactly space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(name: str) -> None:
    """Task functions of this module travel with the job, so executors need no installation."""
    for module in ("duelgauge.llm.common", name):
        if module in sys.modules:
            cloudpickle.register_pickle_by_value(sys.modules[module])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit_bytes: int) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about `limit_bytes` of one column (at least one row each)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(lengths)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + max(limit_bytes - size, 0), side="left")) + 1
            stop = min(max(stop, start + 1), batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            start = stop
            if size >= limit_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def batches_of(columns: dict[str, pa.Array | np.ndarray | list], schema: pa.Schema) -> list[pa.RecordBatch]:
    arrays = [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema]
    return pa.Table.from_arrays(arrays, schema=schema).to_batches()


def key_of(column: str):
    """Non-null text form of a column, so that null is a group of its own in joins and hashes."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


import pyarrow.compute  # noqa: E402,F401
