"""Flow-weighted daily concentrations of high-frequency outlets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.conditions import flag, unless_missing
from freshet.functions.numbers import settle
from freshet.operators.seasonal import assign_season, season_pivot

LITRES_PER_CUBIC_FOOT = 28.32
# Analyte columns, mg/L.
ANALYTES = (
    "tss_mgl", "tp_mgl", "dop_mgl", "no2_no3_mgl", "nh3_mgl", "tkn_mgl", "chloride_mgl",
)
FLUME_MARK = "-F"


def flow_weighted_daily(
    readings: DataFrame,
    analytes: Sequence[str] = ANALYTES,
    factor: float = LITRES_PER_CUBIC_FOOT,
    flume_mark: str = FLUME_MARK,
) -> DataFrame:
    """Daily load over daily flow for each site and analyte.

    One missing reading makes that day's value missing. Days without flow go,
    and so do days where dissolved phosphorus is not below the total.
    """
    litres = F.col("flow_cfs") * F.lit(factor)
    daily = readings.groupBy("site_id", F.to_date("datetime").alias("date")).agg(
        unless_missing(F.sum, litres).alias("flow_l"),
        *[unless_missing(F.sum, F.col(a) * litres).alias(a) for a in analytes],
    )
    weighted = daily.where(F.col("flow_l") > 0).withColumns(
        {a: F.try_divide(F.col(a), F.col("flow_l")) for a in analytes}
    )
    return (
        assign_season(weighted)
        .withColumn("pp_mgl", F.col("tp_mgl") - F.col("dop_mgl"))
        .where(F.col("pp_mgl") > 0)
        .withColumn("year", F.date_format("date", "yyyy"))
        .withColumn("type", flag(F.col("site_id").contains(flume_mark), "Flume", "Tile"))
    )


def tile_means(
    daily: DataFrame, keys: Sequence[str], digits: int = 3, value: str = "dop_mgl"
) -> DataFrame:
    """Mean and deviation over tile outlets, by season, by site or both."""
    return (
        daily.where(F.col("type") == "Tile")
        .groupBy(*keys)
        .agg(
            settle(unless_missing(F.avg, F.col(value)), digits).alias("mean_tile"),
            settle(unless_missing(F.stddev_samp, F.col(value)), digits).alias("sd_tile"),
        )
    )


def tile_season_pivot(daily: DataFrame, digits: int = 3) -> DataFrame:
    return season_pivot(tile_means(daily, ["site_id", "season"], digits), ["site_id"], "mean_tile")
