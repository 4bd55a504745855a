"""Scalar expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in a dirty text column: no units, no underscores, no nan or inf.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(text: Column) -> Column:
    """The double that a text states, else null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0 or null."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def uniform(tag: str, *keys: Column) -> Column:
    """A double in [0, 1) from the MD5 of a tag and keys: the same in every run, partitioning and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(tag), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as DuckDB and C do it: the scaled double to the nearest whole number, halves away from zero. F.round
    rounds the double's shortest decimal text instead: 0.5035 times 1000 is 503.49999999999994 and gives 0.503 here, 0.504 there."""
    scaled = x * F.lit(10.0**digits)
    near = F.rint(scaled)  # halves to even
    whole = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    return F.when(F.abs(scaled) < float("inf"), whole / F.lit(10.0**digits)).otherwise(x)


def strip(text: Column) -> Column:
    """Without whitespace, line ends included, at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def snake(text: Column) -> Column:
    """A display name as a column name."""
    plain = F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(F.regexp_replace(plain, r"^_+", ""), r"_+$", "")


def cents(x: Column) -> Column:
    """Rounded to two digits by decimal arithmetic."""
    return F.round(x.cast("decimal(18,6)"), 2).cast("double")


def percent(x: Column) -> Column:
    """A share as text with two digits, rounded before it is formatted."""
    return F.format_string("%.2f%%", F.round((x * 100).cast("decimal(18,6)"), 2).cast("double"))
