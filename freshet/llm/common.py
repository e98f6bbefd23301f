"""What the operators of this subpackage share: reading tables, words, and shipping code.

Each operator first selects the columns it names, so further columns of its
input, whatever they are called, never meet its own.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.sources.workspace import ship as ship

#: White space of the word definitions, as a regular expression.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in columns))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def records(batches: Iterable[pa.RecordBatch], *columns: str, step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; Python objects exist for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)
