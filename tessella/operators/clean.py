"""Cleaning: columns, coercion and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from tessella.functions.scalar import to_number
from tessella.operators.quantiles import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def drop_tolerant(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the named columns, of which any may be missing."""
    return df.drop(*[n for n in names if n in df.columns])


def coerce(df: DataFrame, keep: list[str]) -> DataFrame:
    """Every column but `keep` as a double; what is no number, NaN included, becomes null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in keep:
            out.append(c)
        elif isinstance(f.dataType, StringType):
            out.append(to_number(c).alias(f.name))
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.when(~F.isnan(c), c.cast("double")).alias(f.name))
        else:
            out.append(c.cast("double").alias(f.name))
    return df.select(*out)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; a column without values has none."""
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items() if v[0] is not None}


def impute_median(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls replaced by the exact medians of fit_on (by default of df itself; give the training rows to avoid leakage)."""
    values = medians(df if fit_on is None else fit_on, columns)
    return df.fillna(values) if values else df
