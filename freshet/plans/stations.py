"""From samples to analysis-ready rows without shuffling the samples.

Everything a row needs to know about its station (low-flow cut-off, number of
usable samples, geometric mean flow) comes from one grouping of (station, flow)
counts. It is stored as one row per station and attached to the usable samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.attributes import enrich_attributes, impact_flags, station_dimension
from freshet.operators.cleaning import is_usable, measured_positive
from freshet.operators.flow import LOW_FLOW_SHARE, MIN_SAMPLES, is_low_flow, low_flow_cutoff
from freshet.operators.order_stats import cumulate, tally
from freshet.operators.seasonal import assign_season
from freshet.operators.sizing import attach, summarised

STATION = ["station_number", "station_name"]


def station_profiles(samples: DataFrame, share: float = LOW_FLOW_SHARE) -> DataFrame:
    """Cut-off, usable-sample count and geometric mean flow per station.

    The rank runs over all flows of the record, before any row is filtered.
    """
    flow = F.col("flow_cfs")
    counts = tally(samples, STATION, "flow_cfs", {"usable": F.count_if(is_usable())})
    logs = F.when(flow > 0, F.ln(flow) * F.col("rows"))
    positive = F.when(flow > 0, F.col("rows"))
    return (
        cumulate(counts, STATION, "flow_cfs")
        .groupBy(*STATION)
        .agg(
            low_flow_cutoff("flow_cfs", share).alias("cutoff"),
            F.sum("usable").alias("n"),
            F.exp(F.try_divide(F.sum(logs), F.sum(positive))).alias("qgm"),
        )
    )


def prepared_samples(
    samples: DataFrame, share: float = LOW_FLOW_SHARE, at_least: int = MIN_SAMPLES
) -> DataFrame:
    """Usable samples of well-sampled stations with low-flow flag, season and
    normalised flow."""
    profiles = station_profiles(samples, share).where(F.col("n") >= at_least)
    rows = attach(measured_positive(samples), summarised(profiles, "station-profiles"), STATION)
    return assign_season(
        rows.withColumn("lowflow", is_low_flow()).withColumn(
            "normalized_flow", F.try_divide(F.col("flow_cfs"), F.col("qgm"))
        )
    ).drop("cutoff")


def attributed_samples(
    prepared: DataFrame,
    gages: DataFrame,
    attributes: DataFrame,
    density: DataFrame,
    crop_min: float = 0.5,
    urban_min: float = 0.1,
) -> DataFrame:
    """Prepared samples with watershed attributes and impact flags."""
    stations = station_dimension(gages, attributes, density)
    return impact_flags(enrich_attributes(prepared, stations), crop_min, urban_min)
