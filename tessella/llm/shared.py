"""Tables that cut lineage, in the folder the cluster shares, and batches of rows for Python workers."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

_unset: list[str] = []
_watched: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, one temporary folder on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _unset:
            _unset.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
        path = _unset[0]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    for paths in _watched:
        paths.append(path)
    return path


@contextlib.contextmanager
def watched() -> Iterator[list[str]]:
    """Within it, the paths that new_path() gives out."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield paths
    finally:
        _watched[:] = [x for x in _watched if x is not paths]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows of texts that a Python worker receives at once: long texts make larger batches of the default size.
BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, queries that run send at most so many rows at once to a Python worker; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    whole = lambda c: c.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get if c.null_count else None)
    return pd.DataFrame({name: whole(column) for name, column in zip(batch.schema.names, batch.columns, strict=True)})


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas() that keeps long values whole beside nulls: columns of integers with nulls arrive as nullable ones."""
    made = to_arrow_schema(DataType.fromDDL(schema))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(_frame(b) for b in batches):
            yield from pa.Table.from_pandas(out, schema=made, preserve_index=False).to_batches()

    return df.mapInArrow(arrow, schema)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet into the shared folder, partitioned by columns if given, and read it back: later stages survive the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a file of a table of few rows holds at least.
FILE_ROWS = 50_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many rows in as few partitions as they need: few rows make few files, whatever the shuffle partitions."""
    return df.coalesce(max(8, rows // FILE_ROWS))


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """df, written, with a column `name` that tells its rows apart."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), label)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize() that nothing reads any more."""
    files = df.inputFiles()
    if files:
        root, _, rest = files[0].partition("/tessella/")
        delete(df.sparkSession, f"{root}/tessella/{rest.split('/')[0]}")


def release(spark: SparkSession) -> None:
    """Ask Spark's cleaner to delete the shuffle files of queries that have ended: it follows the driver's garbage collection, and results don't depend on it."""
    gc.collect()
    spark._jvm.System.gc()


#: A value that is given to more than 1 / HOT_PARTS of all rows is hot: there are fewer than HOT_PARTS such values.
HOT_PARTS = 1000


def join_by_class(rows: DataFrame, classes: DataFrame, keys: list[str], total: int, how: str = "left") -> DataFrame:
    """rows with the columns of classes(keys..., n, ...) by equal keys, n being the rows of a class, of `total` in all.

    Classes of more than total / HOT_PARTS rows are fewer than HOT_PARTS, so they are broadcast; only the rows of the
    others are dealt out by key, and no task receives a large class. rows is read twice.
    """
    hot = classes.where(F.col("n") * HOT_PARTS > total)
    cold = classes.where(F.col("n") * HOT_PARTS <= total)
    found = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    return found.unionByName(rest).drop("n")
