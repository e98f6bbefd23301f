"""Coefficient-of-variation ratio and transport behaviour of a station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.conditions import unless_missing
from freshet.operators.cleaning import MEASURED, round_numeric

CHEMOSTATIC_CV = 0.3
SIGNIFICANT = 0.05


def cv_ratio(
    samples: DataFrame, keys: Sequence[str] = ("station_number",), measured: str = MEASURED
) -> DataFrame:
    """CV of concentration over CV of flow in one pass.

    Flow moments use every row, concentration moments only measured rows
    (zeros included); one missing value makes the moment missing. A station
    without measured rows drops out.
    """
    is_measured = F.col("data_type") == measured
    taken = F.count_if(is_measured)
    srp = F.when(is_measured, F.col("srp"))
    known = F.count(srp) == taken
    flow = F.col("flow_cfs")
    return (
        samples.groupBy(*keys)
        .agg(
            unless_missing(F.avg, flow).alias("flow_mean"),
            unless_missing(F.stddev_samp, flow).alias("flow_sd"),
            F.when(known, F.avg(srp)).alias("srp_mean"),
            F.when(known, F.stddev_samp(srp)).alias("srp_sd"),
            taken.alias("_taken"),
        )
        .where(F.col("_taken") > 0)
        .drop("_taken")
        .withColumn(
            "cv_ratio",
            F.try_divide(
                F.col("flow_mean") * F.col("srp_sd"), F.col("srp_mean") * F.col("flow_sd")
            ),
        )
    )


def behavior(p: Column, slope: Column, cv: Column) -> Column:
    """Behaviour class from unrounded statistics.

    Later rules override earlier ones, and a rule whose test is missing clears
    what came before, so the checks run from the last rule to the first.
    """
    return (
        F.when(cv.isNull(), F.lit(None).cast("string"))
        .when((cv > CHEMOSTATIC_CV) & p.isNull(), F.lit(None).cast("string"))
        .when((cv > CHEMOSTATIC_CV) & (p >= SIGNIFICANT), F.lit("chemodynamic"))
        .when(cv <= CHEMOSTATIC_CV, F.lit("chemostatic"))
        .when(slope < 0, F.lit("diluting"))
        .when(slope > 0, F.lit("mobilizing"))
    )


def transport_table(compared: DataFrame, ratios: DataFrame, digits: int = 2) -> DataFrame:
    """Behaviour and both regressions per station, rounded after classifying.
    Both inputs hold one row per station."""
    joined = compared.join(ratios.select("station_number", "cv_ratio"), "station_number")
    classified = joined.withColumn(
        "behavior", behavior(F.col("p1"), F.col("slope1"), F.col("cv_ratio"))
    )
    return round_numeric(classified, digits).select(
        "station_name", "station_number", "behavior", "cv_ratio",
        "slope1", "p1", "r2v1", "n1", "slope2", "p2", "r2v2", "n2", "pct_slope_change",
    )


def transport_headline(table: DataFrame, significant: float = SIGNIFICANT) -> DataFrame:
    """Fit quality of mobilizing stations, and slope change of strengthened ones.
    Reads the rounded table."""
    mobilizing = F.col("behavior") == "mobilizing"
    stronger = (
        (F.col("slope1") > 0) & (F.col("slope2") > F.col("slope1")) & (F.col("p2") < significant)
    )
    r2, change = F.when(mobilizing, F.col("r2v1")), F.when(stronger, F.col("pct_slope_change"))
    return table.agg(
        F.avg(r2).alias("mean_r2"),
        F.min(r2).alias("min_r2"),
        F.max(r2).alias("max_r2"),
        F.avg(change).alias("mean_change"),
        F.min(change).alias("min_change"),
        F.max(change).alias("max_change"),
        F.count_if(stronger).alias("strengthened"),
    )
