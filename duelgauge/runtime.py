"""Session helpers: shared folder, lineage cuts and bounded constants."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup list that is attached to every row must stay a small constant.
MAX_CONSTANT_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only a session without that setting (tests, a laptop) gets a local temporary folder, which is
    removed when the program ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    local = tempfile.mkdtemp(prefix="duelgauge-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(local)
    return local


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its URI names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Scope of the tables that operators store on the way: they are deleted when it ends.

    Write or collect the results inside; DataFrames made in the scope cannot be read after it.
    """
    begin = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[begin:]:
            delete_path(spark, path)
        del _WRITTEN[begin:]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store the rows as a table in the shared folder and read them back.

    Like a reliable checkpoint it outlives the executors, but it computes the plan once and comes
    back columnar and with its size known.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
        spark.sparkContext.defaultParallelism,
    )


def constant_list(rows: DataFrame, *columns: str, shape: Callable[[Column], Column] | None = None) -> Column:
    """A small table as one sorted array<struct> usable inside any expression.

    The scalar subquery is planned once and its value is shipped as a literal, so no join is
    needed. The row count is checked: a table above MAX_CONSTANT_ROWS is an error. `shape` may
    rearrange the array before it is shipped.
    """
    packed = F.sort_array(F.collect_list(F.struct(*columns)))
    checked = F.when(F.count(F.lit(1)) <= MAX_CONSTANT_ROWS, packed).otherwise(
        F.raise_error(F.lit("constant list is larger than its bound"))
    )
    bounded = rows.limit(MAX_CONSTANT_ROWS + 1)
    listed = bounded.agg(checked.alias("v"))
    return (listed.select(shape(F.col("v")).alias("v")) if shape else listed).scalar()


def constant_row(one_row: DataFrame, *columns: str) -> Column:
    """A one-row table as a struct constant."""
    return one_row.select(F.struct(*columns).alias("v")).scalar()


BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    """Width of a row as Spark estimates it from the types (strings and binaries at 64 bytes at least)."""
    wide = {"string": 64, "binary": 256, "array": 256, "map": 256, "struct": 64}
    return 8 + sum(wide.get(f.dataType.typeName(), 8) for f in df.schema.fields)


def broadcast_if_small(df: DataFrame, sized_by: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcast only where its rows times their width stay below the limit; a larger
    one is left to a shuffle join. `sized_by` has as many rows as `df` but is cheaper to count.
    """
    return F.broadcast(df) if sized_by.count() * row_bytes(df) <= limit_bytes else df


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Pass rows through, failing the job at the first row that breaks the condition."""
    return df.filter(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).isNull()))
