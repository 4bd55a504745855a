"""File sources and sinks."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_unset: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder on a single machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _unset:
            _unset.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
        base = _unset[0]
    return f"{base.rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None) -> DataFrame:
    """A table in csv, json (one document), jsonl, parquet, orc or xlsx (the first sheet)."""
    if fmt == "xls":
        raise ValueError("no reader of the old binary sheets: convert them to XLSX, CSV or Parquet first")
    if fmt == "xlsx":
        from tessella.sources.sheets import read_sheet

        table = read_sheet(spark, path)
        return table if schema is None else table.to(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if fmt == "json":
        return reader.option("multiLine", True).json(path)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt in ("parquet", "orc"):
        return reader.format(fmt).load(path)
    raise ValueError(f"unknown format {fmt}")


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    """The sink of read_table(): CSV with a header and doubled quotes, JSON lines, Parquet or ORC, in as many files as df has partitions."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    else:
        writer.format(fmt).save(path)


def write_document(spark: SparkSession, path: str, value: dict) -> None:
    """One pretty-printed JSON document, non-ASCII kept, in a folder of its own."""
    text = json.dumps(value, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def latest(df: DataFrame, run_key: str) -> DataFrame:
    """Rows of the greatest run key, the last snapshot. Over a partition column only that partition is read."""
    top = df.agg(F.max(run_key).alias("_top"))
    return df.join(F.broadcast(top), F.col(run_key) == F.col("_top")).drop("_top")


def text_lines(df: DataFrame, rows: int) -> list[str]:
    """The header and first rows of a table in columns as wide as their longest cell, and a line that tells if there are more."""
    shown = df.limit(rows + 1).collect()
    widths = [max([len(c), *(len(str(r[c])) for r in shown[:rows])]) for c in df.columns]
    line = lambda values: "  ".join(str(v).ljust(w) for v, w in zip(values, widths, strict=True)).rstrip()
    return [line(df.columns), *(line(r) for r in shown[:rows]), *([f"... first {rows} rows"] if len(shown) > rows else [])]
