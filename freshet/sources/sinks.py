"""CSV for publication, Parquet for hand-offs between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.sources.readers import MISSING


def write_csv(df: DataFrame, path: str, sep: str = ",", missing: str = MISSING) -> None:
    """Headed text files, one per task; missing values are spelled out."""
    df.write.csv(path, header=True, sep=sep, nullValue=missing, quote='"', escape='"')


def write_handoff(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.parquet(path, partitionBy=partition_by)


def read_handoff(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
