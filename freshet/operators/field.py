"""Field chemistry: joins, stream types, event summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.conditions import sole_value
from freshet.functions.labels import relabel
from freshet.operators.sizing import attach, counted

# Hydrographic feature codes and their labels.
STREAM_TYPES = {
    33400: "Connector",
    33600: "Ditch",
    46006: "Perennial Stream/River",
    46003: "Intermittent Stream/River",
}
# Shorter names for display; a type not listed has no short name.
SHORT_TYPES = {
    "Ditch": "Ditch",
    "Intermittent Stream/River": "Intermittent Stream",
    "Perennial Stream/River": "Perennial Stream",
}
MICROGRAMS = 1000


def watershed_areas(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("Site_ID").alias("site_id"), F.col("WS_area").alias("ws_area"))


def field_samples(
    chemistry: DataFrame, areas: DataFrame, sites: DataFrame, date_format: str = "M/d/yyyy"
) -> DataFrame:
    """Chemistry with watershed area and site attributes, typed and labelled."""
    joined = attach(attach(chemistry, counted(areas), ["site_id"]), counted(sites), ["site_id"])
    date = F.col("date")
    if dict(chemistry.dtypes)["date"] == "string":
        date = F.try_to_date(date, date_format)
    return joined.withColumns(
        {"date": date, "stream_type": relabel(F.col("fcode"), STREAM_TYPES)}
    ).withColumns({"month": F.month("date"), "year": F.year("date")})


def during(events: Sequence[tuple[int, int]]) -> Column:
    """Rows of any of the given (year, month) events."""
    test = F.lit(False)
    for year, month in events:
        test = test | ((F.col("year") == year) & (F.col("month") == month))
    return test


def event_rows(
    samples: DataFrame, basins: Sequence[str], events: Sequence[tuple[int, int]]
) -> DataFrame:
    return samples.where(F.col("basin").isin(list(basins)) & during(events))


def event_summary(samples: DataFrame, micrograms: float = MICROGRAMS) -> DataFrame:
    """Mean concentration per site in mg/L, skipping missing values."""
    return samples.groupBy("site_id").agg(
        F.avg(F.col("srp") / F.lit(float(micrograms))).alias("mean_srp"),
        sole_value(F.col("stream_type")).alias("stream_type"),
        sole_value(F.col("outlet_typ")).alias("outlet_typ"),
    )


def stream_type_means(samples: DataFrame, micrograms: float = MICROGRAMS) -> DataFrame:
    return samples.groupBy("stream_type", "outlet_typ").agg(
        F.avg(F.col("srp") / F.lit(float(micrograms))).alias("mean_srp"),
        F.count(F.lit(1)).alias("n"),
    )


def samples_by_month(samples: DataFrame) -> DataFrame:
    return samples.groupBy("month", "year").agg(F.count(F.lit(1)).alias("n"))


def sites_by_type(summary: DataFrame) -> DataFrame:
    return summary.groupBy("stream_type").agg(F.count(F.lit(1)).alias("sites"))
