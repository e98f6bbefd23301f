"""Renaming, typing and complete-case filtering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions.labels import strip_prefix_letter
from freshet.functions.numbers import settle

# Headers of a raw concentration-discharge file.
RAW_HEADERS = {
    "Station": "station_name",
    "Station number": "station_number",
    "Sample date": "date",
    "Daily Conc. (mg/L)": "srp",
    "Flow (cfs)": "flow_cfs",
    "Data type": "data_type",
}
SAMPLE_COLUMNS = ("station_number", "station_name", "date", "srp", "flow_cfs", "data_type")
MEASURED = "discrete sample point"
DATE_FORMAT = "M/d/yyyy"


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows with no missing value in any column (run before projecting columns away)."""
    return df.where(reduce(and_, [F.col(f"`{c}`").isNotNull() for c in df.columns]))


def clean_samples(
    raw: DataFrame, headers: Mapping[str, str] = RAW_HEADERS, date_format: str = DATE_FORMAT
) -> DataFrame:
    """Raw file rows to typed samples. A field that does not parse becomes NULL,
    which is why it happens after the complete-case filter and not before."""
    return (
        complete_cases(raw)
        .withColumnsRenamed(dict(headers))
        .select(
            strip_prefix_letter(F.col("station_number").cast("string")).alias("station_number"),
            "station_name",
            F.try_to_date(F.col("date").cast("string"), date_format).alias("date"),
            F.col("srp").try_cast("double").alias("srp"),
            F.col("flow_cfs").try_cast("double").alias("flow_cfs"),
            "data_type",
        )
    )


def is_usable(measured: str = MEASURED, columns: Sequence[str] = SAMPLE_COLUMNS) -> Column:
    """Measured, complete, and positive in flow and concentration."""
    complete = reduce(and_, [F.col(c).isNotNull() for c in columns])
    return complete & (F.col("data_type") == measured) & (F.col("flow_cfs") > 0) & (F.col("srp") > 0)


def measured_positive(samples: DataFrame, measured: str = MEASURED) -> DataFrame:
    return samples.where(is_usable(measured))


def hold_out(samples: DataFrame, season: str = "Late Summer") -> DataFrame:
    """Drop rows that are both low flow and of one season, keep the rest."""
    return samples.where(~((F.col("lowflow") == "yes") & (F.col("season") == season)))


def at_sites(samples: DataFrame, names: Sequence[str], column: str = "station_name") -> DataFrame:
    return samples.where(F.col(column).isin(list(names)))


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column; integers and text stay as they are."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: settle(F.col(f"`{c}`"), digits) for c in floating})
