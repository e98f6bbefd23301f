"""The whole analysis from input tables to published files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.attributes import station_dimension
from freshet.operators.field import event_rows, event_summary, field_samples
from freshet.operators.weighted import flow_weighted_daily, tile_means, tile_season_pivot
from freshet.plans import tables
from freshet.plans.stations import prepared_samples
from freshet.sources.sinks import read_handoff, write_csv, write_handoff


@dataclass(frozen=True)
class Inputs:
    """Typed input tables; see ``freshet.sources.schemas`` for their files."""

    samples: DataFrame
    gages: DataFrame
    attributes: DataFrame
    tile_density: DataFrame
    tile_readings: DataFrame
    field_chemistry: DataFrame
    field_areas: DataFrame
    field_sites: DataFrame


def publish(
    inputs: Inputs,
    folder: str,
    crop_min: float = 0.5,
    urban_min: float = 0.1,
    basins: tuple[str, ...] = ("LS",),
    events: tuple[tuple[int, int], ...] = ((2014, 8),),
) -> list[str]:
    """Write every published table under ``folder`` and return their names.

    Tables that later steps read (prepared samples, seasonal means with all
    attributes, daily concentrations) are handed over as Parquet.
    """
    spark = inputs.samples.sparkSession
    written: list[str] = []

    def handed(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/handoff/{name}"
        write_handoff(df, path)
        return read_handoff(spark, path)

    def publish_table(name: str, df: DataFrame) -> None:
        write_csv(df, f"{folder}/{name}")
        written.append(name)

    prepared = handed("prepared_samples", prepared_samples(inputs.samples))
    publish_table("transport_behavior", tables.transport_of(inputs.samples, prepared))
    publish_table("lowflow_sample_counts", tables.appendix_counts(prepared))

    stations = station_dimension(inputs.gages, inputs.attributes, inputs.tile_density)
    means = handed(
        "seasonal_means",
        tables.site_seasons(prepared, stations, crop_min=crop_min, urban_min=urban_min),
    )
    publish_table("seasonal_means", tables.appendix_means(means))
    publish_table("seasonal_regressions", tables.appendix_regressions(means))

    daily = handed("tile_daily", flow_weighted_daily(inputs.tile_readings))
    publish_table("tile_daily", daily)
    publish_table("tile_site_seasons", tile_season_pivot(daily))
    publish_table("tile_seasons", tile_means(daily, ["season"]))
    publish_table("tile_sites", tile_means(daily, ["site_id"]))

    field = field_samples(inputs.field_chemistry, inputs.field_areas, inputs.field_sites)
    publish_table("field_event", event_summary(event_rows(field, basins, events)))
    return written


def model_rows(
    means: DataFrame, season: str = "Late Summer", at_least: int = 3
) -> DataFrame:
    """Rows of one season with enough samples, one per station, for the model."""
    return means.where((F.col("season") == season) & (F.col("n") >= at_least))
