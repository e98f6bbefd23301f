"""Delimited readers that take the declared columns by the names in the header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "NA"


def _as_text(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns of the header as text. Every file must have the header of the first; a file
    that differs raises when it is read."""
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"'}
    names = spark.read.csv(path, **options).columns
    texts = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.read.schema(texts).csv(path, enforceSchema=False, **options)


def _declared(rows: DataFrame, schema: str, path: str, missing: str, others: bool = False) -> list[Column]:
    """The declared columns of text rows, and after them the others as text where wanted: blank text
    stays blank, a blank or unreadable number is missing."""
    fields = T.StructType.fromDDL(schema).fields
    if absent := [f.name for f in fields if f.name not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(absent)}; its header is {', '.join(rows.columns)}")

    def typed(field: T.StructField) -> Column:
        text = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return F.when(text == missing, None).otherwise(F.coalesce(text, F.lit(""))).alias(field.name)
        return F.trim(text).try_cast(field.dataType).alias(field.name)

    names = {f.name for f in fields}
    more = [T.StructField(c, T.StringType()) for c in rows.columns if others and c not in names]
    return [typed(f) for f in [*fields, *more]]


def read_delimited(
    spark: SparkSession, path: str, schema: str, sep: str = ",", missing: str = MISSING, others: bool = False
) -> DataFrame:
    """The declared columns of a headed text table, whatever their order and whatever others it has.

    ``others`` keeps the undeclared ones as text, for a complete-case filter over all raw columns."""
    rows = _as_text(spark, path, sep)
    return rows.select(*_declared(rows, schema, path, missing, others))


def read_tab(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_delimited(spark, path, schema, sep="\t")


def read_matching(
    spark: SparkSession, folder: str, pattern: str, schema: str, missing: str = MISSING
) -> DataFrame:
    """Every file (or folder of part files) matching a glob, with each row's file."""
    path = f"{folder}/{pattern}"
    rows = _as_text(spark, path, ",")
    return rows.select(*_declared(rows, schema, path, missing), F.col("_metadata.file_path").alias("path"))


def read_bundle(spark: SparkSession, paths: Sequence[str], schemas: Sequence[str]) -> list[DataFrame]:
    """Several attribute tables, each with its own schema, ready for a bundle join."""
    return [read_delimited(spark, path, schema) for path, schema in zip(paths, schemas)]
