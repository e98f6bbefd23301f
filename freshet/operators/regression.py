"""Grouped straight-line fits from running moments, with full test statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.conditions import flag
from freshet.functions.labels import significance_label
from freshet.functions.numbers import settle, t_two_sided
from freshet.functions.seasons import level_order
from freshet.operators.sizing import attach, summarised

LINE = ("slope", "intercept", "std_error", "t_stat", "p", "r2", "n")
GLANCE = ("adj_r2", "sigma", "f_stat", "log_lik", "aic", "bic", "deviance", "df_residual")


def _paired(y: Column, x: Column, where: Column | None, name: str) -> dict[str, Column]:
    """Both sides as columns, missing together: a row counts if both are known."""
    use = y.isNotNull() & x.isNotNull()
    if where is not None:
        use = use & where
    return {f"_y_{name}": F.when(use, y), f"_x_{name}": F.when(use, x)}


def _moments(name: str) -> Column:
    """Six partial aggregates of a ``_paired`` pair, as one struct. Pairs are
    projected before grouping so that each logarithm is taken once per row."""
    y, x = F.col(f"_y_{name}"), F.col(f"_x_{name}")
    return F.struct(
        F.count(x).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    )


def _add_line(df: DataFrame, moments: str = "moments", suffix: str = "") -> DataFrame:
    """Closed-form least squares from a ``_moments`` struct, as suffixed columns.

    Without spread in x there is no slope; without spread in y no r2; below
    three points no test. An exact fit has an infinite t and p = 0. Each step is
    its own projection, so later ones read columns, not repeated expressions.
    """
    n, mx, my, sxx, syy, sxy = (
        F.col(f"{moments}.{m}") for m in ("n", "mx", "my", "sxx", "syy", "sxy")
    )

    def made(name: str) -> Column:
        return F.col(name + suffix)

    def add(**columns: Column) -> None:
        nonlocal df
        df = df.withColumns({name + suffix: value for name, value in columns.items()})

    add(n=n, df_residual=n - 2, slope=F.when(sxx > 0, F.try_divide(sxy, sxx)))
    add(
        intercept=my - made("slope") * mx,
        deviance=F.greatest(syy - made("slope") * sxy, F.lit(0.0)),
        r2=F.when((sxx > 0) & (syy > 0), F.try_divide(sxy * sxy, sxx * syy)),
    )
    dof = made("df_residual")
    add(sigma=F.when(dof > 0, F.sqrt(F.try_divide(made("deviance"), dof))))
    add(std_error=F.try_divide(made("sigma"), F.sqrt(sxx)))
    slope, error = made("slope"), made("std_error")
    add(
        t_stat=F.when(error > 0, F.try_divide(slope, error)).when(
            (error == 0) & (slope != 0), F.signum(slope) * F.lit(float("inf"))
        )
    )
    add(p=t_two_sided("t_stat" + suffix, "df_residual" + suffix))
    return df


def _add_glance(df: DataFrame) -> DataFrame:
    n, dof, deviance = F.col("n"), F.col("df_residual"), F.col("deviance")
    return df.withColumns(
        {
            "adj_r2": F.when(dof > 0, 1 - (1 - F.col("r2")) * F.try_divide(n - 1, dof)),
            "f_stat": F.col("t_stat") * F.col("t_stat"),
            "log_lik": -n / 2 * (math.log(2 * math.pi) + F.ln(F.try_divide(deviance, n)) + 1),
        }
    ).withColumns(
        {
            "aic": -2 * F.col("log_lik") + 6,
            "bic": -2 * F.col("log_lik") + 3 * F.ln(n),
        }
    )


def fit_lines(
    df: DataFrame,
    keys: Sequence[str],
    y: Column,
    x: Column,
    where: Column | None = None,
    glance: bool = False,
) -> DataFrame:
    """Least-squares ``y = intercept + slope * x`` per group."""
    lines = _add_line(
        df.withColumns(_paired(y, x, where, "line"))
        .groupBy(*keys)
        .agg(_moments("line").alias("moments"))
        .where(F.col("moments.n") > 0)
    )
    if glance:
        return _add_glance(lines).select(*keys, *LINE, *GLANCE)
    return lines.select(*keys, *LINE)


def fit_scenarios(
    df: DataFrame,
    keys: Sequence[str],
    y: Column,
    scenarios: Mapping[str, tuple[Column, Column | None]],
) -> DataFrame:
    """Several fits (predictor, row condition) in one pass, stacked as rows."""
    stacked = [
        F.struct(F.lit(label).alias("scenario"), F.col(f"s{i}").alias("moments"))
        for i, label in enumerate(scenarios)
    ]
    names = [f"s{i}" for i in range(len(scenarios))]
    pairs = {}
    for name, (x, where) in zip(names, scenarios.values()):
        pairs |= _paired(y, x, where, name)
    groups = (
        df.withColumns(pairs).groupBy(*keys).agg(*[_moments(name).alias(name) for name in names])
    )
    rows = groups.select(*keys, F.inline(F.array(*stacked))).where(F.col("moments.n") > 0)
    return _add_line(rows).select(*keys, "scenario", *LINE)


def with_residuals(df: DataFrame, keys: Sequence[str], y: Column, x: Column) -> DataFrame:
    """Rows with their group's fitted value and residual."""
    fits = fit_lines(df, keys, y, x).select(*keys, "intercept", "slope")
    return (
        attach(df, summarised(fits, "lines"), keys)
        .withColumn("fitted", F.col("intercept") + F.col("slope") * x)
        .withColumn("residual", y - F.col("fitted"))
        .select(*df.columns, "fitted", "residual")
    )


def log_log() -> tuple[Column, Column]:
    return F.log10("srp"), F.log10("normalized_flow")


def is_held_out(season: str = "Late Summer") -> Column:
    return (F.col("lowflow") == "yes") & (F.col("season") == season)


def cq_regression(samples: DataFrame, keys: Sequence[str] = ("station_name",)) -> DataFrame:
    """Concentration-discharge line per station, log10 on both sides."""
    return fit_lines(samples, keys, *log_log())


def cq_regression_holdout(
    samples: DataFrame, keys: Sequence[str] = ("station_name",), season: str = "Late Summer"
) -> DataFrame:
    return fit_lines(samples, keys, *log_log(), where=~is_held_out(season))


def regression_compare(
    samples: DataFrame,
    keys: Sequence[str] = ("station_number", "station_name"),
    season: str = "Late Summer",
    significant: float = 0.05,
) -> DataFrame:
    """Fit with all rows (1) and without late-summer low flows (2), both in one
    pass, with flags for what changed. A station left empty by (2) drops out."""
    y, x = log_log()
    groups = (
        samples.withColumns(_paired(y, x, None, "all"))
        .withColumns(_paired(F.col("_y_all"), F.col("_x_all"), ~is_held_out(season), "kept"))
        .groupBy(*keys)
        .agg(_moments("all").alias("all_rows"), _moments("kept").alias("kept_rows"))
        .where((F.col("all_rows.n") > 0) & (F.col("kept_rows.n") > 0))
    )
    col = F.col
    compared = ("slope", "t_stat", "p", "r2", "n")
    return (
        _add_line(_add_line(groups, "all_rows", "1"), "kept_rows", "2")
        .select(*keys, *[f"{c}{side}" for side in "12" for c in compared])
        .withColumns(
            {
                "slope_change": flag(col("slope2") > col("slope1"), "Yes", "No"),
                "p_change": flag(col("p2") < col("p1"), "Yes", "No"),
                "r2_change": flag(col("r22") > col("r21"), "Yes", "No"),
                "sig1": flag(col("p1") < significant, "Yes", "No"),
                "sig2": flag(col("p2") < significant, "Yes", "No"),
                "pct_slope_change": F.try_divide(col("slope2") - col("slope1"), col("slope1")) * 100,
            }
        )
        .withColumnsRenamed({"r21": "r2v1", "r22": "r2v2"})
    )


def regression_scenarios(
    site_seasons: DataFrame, few_sources: float = 0.005, digits: int = 2
) -> DataFrame:
    """Seasonal fits of log10 mean concentration on source density and on
    cropland, each with all watersheds and with a restricted set."""
    density, crop = F.col("wwtp_dens"), F.col("pct_crop")
    fits = fit_scenarios(
        site_seasons,
        ["season"],
        F.log10("mean_srp"),
        {
            "source density, all watersheds": (density, None),
            "source density, few sources": (density, density < few_sources),
            "cropland, all watersheds": (crop, None),
            "cropland, no sources": (crop, density == 0),
        },
    )
    return fits.select(
        "scenario",
        "season",
        level_order(F.col("season")).alias("season_ord"),
        settle(F.col("slope"), digits).alias("slope"),
        settle(F.col("t_stat"), digits).alias("t_stat"),
        F.col("p"),
        significance_label(F.col("p"), digits).alias("p_label"),
        settle(F.col("r2"), digits).alias("r2"),
        "n",
    ).orderBy("season_ord", "scenario")
