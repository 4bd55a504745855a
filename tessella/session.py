"""Session construction and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tessella") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
