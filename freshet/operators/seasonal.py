"""Low-flow summaries by station and season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.numbers import settle
from freshet.functions.seasons import SEASONS, level_order, season_of
from freshet.operators.order_stats import quantiles
from freshet.operators.sizing import Sized, attach, summarised
from freshet.sources.workspace import stored

MIN_GROUP = 3
TOTAL_LABEL = "Total number of sites with >3 samples"


def assign_season(samples: DataFrame, date: str = "date") -> DataFrame:
    return (
        samples.withColumn("month", F.month(date))
        .withColumn("season", season_of(F.col("month")))
        .withColumn("season_ord", level_order(F.col("season")))
    )


def low_flow_rows(samples: DataFrame) -> DataFrame:
    """Low-flow rows with a non-zero, known concentration and flow."""
    return samples.where(
        (F.col("srp") != 0) & (F.col("flow_cfs") != 0) & (F.col("lowflow") == "yes")
    )


def seasonal_low_flow_mean(
    samples: DataFrame, keys: Sequence[str] = ("station_number", "season"), digits: int = 3
) -> DataFrame:
    """Mean (rounded), sample deviation and count; the deviation of one row is NULL."""
    return (
        low_flow_rows(samples)
        .groupBy(*keys)
        .agg(
            settle(F.avg("srp"), digits).alias("mean_srp"),
            F.stddev_samp("srp").alias("sd_srp"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def mask_small_groups(
    summary: DataFrame, at_least: int = MIN_GROUP, value: str = "mean_srp"
) -> DataFrame:
    return summary.withColumn(value, F.when(F.col("n") >= at_least, F.col(value)))


def season_sample_count(
    samples: DataFrame, keys: Sequence[str] = ("station_name",)
) -> DataFrame:
    """Low-flow samples per station and season, long form."""
    return low_flow_rows(samples).groupBy(*keys, "season").agg(F.count(F.lit(1)).alias("n"))


def season_pivot(long: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """One column per season, always all six and in declared order."""
    return long.groupBy(*ids).pivot("season", list(SEASONS)).agg(F.first(value))


def season_unpivot(wide: DataFrame, ids: Sequence[str], value: str = "count") -> DataFrame:
    """Back to long form; empty cells stay as rows with a NULL."""
    return wide.unpivot(list(ids), list(SEASONS), "season", value)


def season_site_totals(counts: DataFrame, at_least: int = MIN_GROUP) -> DataFrame:
    """Stations with enough samples, per season, as one labelled wide row."""
    per_season = (
        counts.where(F.col("n") >= at_least).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    )
    labelled = per_season.withColumn("station_name", F.lit(TOTAL_LABEL))
    return season_pivot(labelled, ["station_name"], "n")


def season_count_with_total(counts: DataFrame, at_least: int = MIN_GROUP) -> DataFrame:
    wide = season_pivot(counts, ["station_name"], "n")
    return wide.unionByName(season_site_totals(counts, at_least))


def attach_season_counts(samples: DataFrame, counts: Sized) -> DataFrame:
    """Season counts of the station, from the table without its total row."""
    return attach(samples, counts, ["station_name", "season"])


def sites_without_low_flow(
    samples: DataFrame, keys: Sequence[str] = ("station_number", "station_name")
) -> DataFrame:
    """Key combinations that occur, but never with a low-flow sample. One pass:
    both the occurrence and the low-flow count come from the same grouping."""
    low = (F.col("srp") != 0) & (F.col("flow_cfs") != 0) & (F.col("lowflow") == "yes")
    return (
        samples.groupBy(*keys)
        .agg(F.count_if(low).alias("_low"))
        .where(F.col("_low") == 0)
        .select(*keys)
    )


def samples_per_site_stats(
    samples: DataFrame, keys: Sequence[str] = ("station_number",)
) -> DataFrame:
    """Mean, median, least and most rows per station."""
    per_site = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per_site = stored(per_site, "samples-per-site")
    whole = per_site.agg(
        F.avg("n").alias("mean_n"), F.min("n").cast("bigint").alias("min_n"), F.max("n").cast("bigint").alias("max_n")
    )
    return whole.join(F.broadcast(quantiles(per_site, [], "n", {"median_n": 0.5})), F.lit(True), "left")


def sites_above_threshold(
    site_seasons: DataFrame,
    thresholds: DataFrame,
    high_source: float = 0.005,
    digits: int = 3,
    at_least: int = MIN_GROUP,
) -> DataFrame:
    """Per season, stations above the season's own threshold: all of them, those
    with a dense point source, and the number of stations with enough samples.

    Seasons without any dense-source station are left out. ``thresholds`` has one
    row per season, and both sides of the last join do too.
    """
    above = settle(F.col("mean_srp"), digits) > settle(F.col("mean_tile"), digits)
    dense = F.col("wwtp_dens") > high_source
    enough = site_seasons.where(F.col("n") >= at_least)
    return (
        attach(enough, summarised(thresholds, "thresholds"), ["season"])
        .groupBy("season")
        .agg(
            F.count_if(above).alias("total_above"),
            F.count_if(above & dense).alias("total_above_high_source"),
            F.count_if(dense).alias("_dense"),
            F.count(F.lit(1)).alias("sites"),
        )
        .where(F.col("_dense") > 0)
        .drop("_dense")
    )


def threshold_site_count(
    summary: DataFrame,
    transport: DataFrame,
    described: Sized,
    season: str = "Late Summer",
    eutrophic: float = 0.02,
    drained: float = 0.033,
    significant: float = 0.05,
) -> DataFrame:
    """Three counts over the means of one season, in one pass.

    ``eutrophic_any`` takes all unmasked means and ``>=``; ``eutrophic_masked`` needs enough
    samples, ``>``, and a station that has transport results and attributes (``described``: one
    row per station); ``strengthened`` is above the drainage level with a stronger positive slope
    once late-summer low flows are held out.
    """
    mean = F.col("mean_srp")
    fits = transport.select("station_number", "pct_slope_change", "slope2", "p2", F.lit(True).alias("has_transport"))
    known = Sized(described.frame.select("station_number", F.lit(True).alias("has_attributes")), described.rows)
    rows = attach(summary.where(F.col("season") == season), summarised(fits, "transport"), ["station_number"], "left")
    rows = attach(rows, known, ["station_number"], "left")
    masked = (F.col("n") >= MIN_GROUP) & (mean > eutrophic) & F.col("has_transport") & F.col("has_attributes")
    stronger = (
        (F.col("pct_slope_change") > 0) & (F.col("slope2") > 0) & (F.col("p2") <= significant)
    )
    return rows.agg(
        F.count_if(mean >= eutrophic).alias("eutrophic_any"),
        F.count_if(masked).alias("eutrophic_masked"),
        F.count_if((mean > drained) & stronger).alias("strengthened"),
    )


def impact_season_summary(samples: DataFrame, digits: int = 3) -> DataFrame:
    return (
        samples.where(F.col("lowflow") == "yes")
        .groupBy("impacted", "season")
        .agg(
            settle(F.avg("srp"), digits).alias("mean_srp"),
            F.max("srp").alias("max_srp"),
            F.min("srp").alias("min_srp"),
        )
    )


