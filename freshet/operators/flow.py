"""Flow percentile ranks, low-flow flags, geometric mean flow, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.conditions import present
from freshet.functions.numbers import geometric_mean
from freshet.operators.order_stats import attach_by_value, cumulate, mean_rank_fraction, tally
from freshet.operators.sizing import attach, summarised

LOW_FLOW_SHARE = 0.25
MIN_SAMPLES = 20


def flow_percent_rank(
    samples: DataFrame, keys: Sequence[str] = ("station_name",), flow: str = "flow_cfs"
) -> DataFrame:
    """Add ``percent_rank``: mean rank of ties over the station's row count."""
    keys = list(keys)
    ranked = cumulate(tally(samples, keys, flow), keys, flow).select(
        *keys, flow, "rows", mean_rank_fraction(flow).alias("percent_rank")
    )
    return attach_by_value(samples, ranked, keys, flow).drop("rows")


def low_flow_cutoffs(
    samples: DataFrame,
    keys: Sequence[str] = ("station_name",),
    flow: str = "flow_cfs",
    share: float = LOW_FLOW_SHARE,
) -> DataFrame:
    """Per station, the largest flow whose rank fraction is within ``share``."""
    keys = list(keys)
    return (
        cumulate(tally(samples, keys, flow), keys, flow)
        .groupBy(*keys)
        .agg(low_flow_cutoff(flow, share).alias("cutoff"))
    )


def low_flow_cutoff(flow: str = "flow_cfs", share: float = LOW_FLOW_SHARE) -> Column:
    """Aggregate over ``cumulate`` rows: rank fraction rises with flow, so one
    threshold per station stands for the rank of each of its rows."""
    return F.max(F.when(mean_rank_fraction(flow) <= share, F.col(flow)))


def is_low_flow(flow: str = "flow_cfs", cutoff: str = "cutoff") -> Column:
    known = present(F.col(flow)).isNotNull()
    low = F.coalesce(F.col(flow) <= F.col(cutoff), F.lit(False))
    return F.when(known & low, F.lit("yes")).when(known, F.lit("no"))


def flag_low_flow(
    samples: DataFrame,
    keys: Sequence[str] = ("station_name",),
    flow: str = "flow_cfs",
    share: float = LOW_FLOW_SHARE,
) -> DataFrame:
    """Add ``lowflow`` (yes/no) without shuffling the samples themselves."""
    cutoffs = summarised(low_flow_cutoffs(samples, keys, flow, share), "low-flow-cutoffs")
    return (
        attach(samples, cutoffs, keys, "left")
        .withColumn("lowflow", is_low_flow(flow))
        .select(*samples.columns, "lowflow")
    )


def geometric_mean_flow(
    samples: DataFrame, keys: Sequence[str] = ("station_number",), flow: str = "flow_cfs"
) -> DataFrame:
    """Geometric mean of the non-zero flows of the whole record."""
    return (
        samples.where(F.col(flow) != 0)
        .groupBy(*keys)
        .agg(geometric_mean(F.col(flow)).alias("qgm"))
    )


def normalize_flow(
    samples: DataFrame,
    record: DataFrame | None = None,
    keys: Sequence[str] = ("station_number",),
    flow: str = "flow_cfs",
) -> DataFrame:
    """Flow over the station's geometric mean flow, taken from ``record``."""
    means = geometric_mean_flow(samples if record is None else record, keys, flow)
    return attach(samples, summarised(means, "mean-flow"), keys).withColumn(
        "normalized_flow", F.try_divide(F.col(flow), F.col("qgm"))
    )


def min_samples_per_site(
    samples: DataFrame, at_least: int = MIN_SAMPLES, keys: Sequence[str] = ("station_name",)
) -> DataFrame:
    """Rows of stations with enough rows, each carrying its station's count ``n``."""
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return attach(samples, summarised(counts, "sample-counts"), keys)
