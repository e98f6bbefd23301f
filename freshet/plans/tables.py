"""The published tables, each from analysis-ready rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.numbers import settle
from freshet.operators.attributes import enrich_attributes, impact_flags
from freshet.operators.regression import regression_compare, regression_scenarios
from freshet.operators.seasonal import (
    mask_small_groups,
    season_count_with_total,
    season_pivot,
    season_sample_count,
    seasonal_low_flow_mean,
)
from freshet.operators.sizing import Sized
from freshet.operators.transport import cv_ratio, transport_table
from freshet.plans.stations import STATION


def transport_of(samples: DataFrame, prepared: DataFrame, digits: int = 2) -> DataFrame:
    """Behaviour per station: fits from prepared rows, variation from all rows."""
    return transport_table(regression_compare(prepared, STATION), cv_ratio(samples), digits)


def site_seasons(
    prepared: DataFrame,
    stations: Sized,
    digits: int = 3,
    crop_min: float = 0.5,
    urban_min: float = 0.1,
) -> DataFrame:
    """Masked seasonal low-flow means with watershed attributes and flags."""
    means = mask_small_groups(seasonal_low_flow_mean(prepared, [*STATION, "season"], digits))
    return impact_flags(enrich_attributes(means, stations), crop_min, urban_min)


def appendix_means(table: DataFrame, digits: int = 3, area_digits: int = 2) -> DataFrame:
    """Seasonal means side by side with area, impact and source density."""
    rounded = table.withColumns(
        {
            "drainage_area_km2": settle(F.col("ws_area"), area_digits),
            "source_density": settle(F.col("wwtp_dens"), digits),
        }
    )
    ids = ["station_name", "drainage_area_km2", "impacted", "source_density"]
    return season_pivot(rounded, ids, "mean_srp")


def appendix_counts(prepared: DataFrame) -> DataFrame:
    return season_count_with_total(season_sample_count(prepared))


def appendix_regressions(table: DataFrame, digits: int = 2) -> DataFrame:
    """Source-density and cropland fits over groups that passed the count mask."""
    return regression_scenarios(table.where(F.col("mean_srp").isNotNull()), digits=digits)
