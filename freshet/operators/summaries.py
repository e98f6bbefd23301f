"""Numbers behind the summaries and figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.conditions import present
from freshet.operators.order_stats import quantiles
from freshet.operators.regression import fit_lines
from freshet.operators.sizing import attach, summarised
from freshet.sources.workspace import stored

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least, quartiles, mean, greatest and missing count of each column: all columns in one long
    form, of which only counts and partial sums are shuffled."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    quartiles = quantiles(long, ["column_name"], "value", QUARTILES)
    known = present(F.col("value"))
    rest = long.groupBy("column_name").agg(
        F.min(known).alias("minimum"),
        F.avg(known).alias("mean"),
        F.max(known).alias("maximum"),
        F.count_if(known.isNull()).alias("missing"),
    )
    return rest.join(quartiles, "column_name", "left")


def boxplot_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    value_range: tuple[float, float] | None = None,
    reach: float = 1.5,
) -> DataFrame:
    """Hinges, whiskers within ``reach`` times the hinge spread, and outliers.

    Rows outside ``value_range`` are dropped first, as axis limits would.
    """
    v = F.col(value)
    rows = df.where(present(v).isNotNull())
    if value_range is not None:
        rows = rows.where(v.between(*value_range))
    hinges = summarised(quantiles(rows, keys, value, QUARTILES), "hinges")
    step = (F.col("q3") - F.col("q1")) * reach
    inside = v.between(F.col("q1") - step, F.col("q3") + step)
    return (
        attach(rows.select(*keys, value), hinges, keys)
        .groupBy(*keys, *QUARTILES)
        .agg(
            F.min(F.when(inside, v)).alias("lower_whisker"),
            F.max(F.when(inside, v)).alias("upper_whisker"),
            F.count_if(~inside).alias("outliers"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def histogram_fixed_width(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts in bins centred on multiples of ``width``, beside the overall mean.
    The stored bins give the mean as a scalar subquery, so the rows are read once."""
    bins = (
        df.where(present(F.col(value)).isNotNull())
        .groupBy(F.ceil(F.col(value) / F.lit(float(width)) - 0.5).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("_sum"))
    )
    bins = stored(bins, "bins")
    mean = bins.agg(F.sum("_sum") / F.sum("n")).scalar()
    centre = F.col("bin") * F.lit(float(width))
    return bins.select("bin", "n", centre.alias("centre"), mean.alias("mean"))


def facet_lines(
    df: DataFrame,
    facet: str,
    y: Column,
    x: Column,
    y_range: tuple[float, float] | None = None,
    x_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Trend line and squared correlation per facet, after axis limits."""
    rows = df
    for side, limits in ((y, y_range), (x, x_range)):
        if limits is not None:
            rows = rows.where(side.between(*limits))
    return fit_lines(rows, [facet], y, x).select(facet, "intercept", "slope", "r2", "n")


def out_of_range_counts(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Rows above each column's plotting limit, beside the row count."""
    long = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"),
                     F.lit(float(top)).alias("top"))
            for c, top in limits.items()
        ]
    )
    return (
        df.select(F.inline(long))
        .groupBy("column_name")
        .agg(
            F.count_if(F.col("value") > F.col("top")).alias("above"),
            F.count(F.lit(1)).alias("total"),
        )
    )
