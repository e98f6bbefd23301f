"""Exact ranks and quantiles without sorting one group in one task.

``row_number() over (partition by station order by flow)`` puts a whole station
into one task, and the ``percentile`` aggregate keeps every distinct value of a
group in one buffer. Quantiles come from counts per band of values, refined only
where a wanted position lies (``at_positions``). Where every row's rank is wanted,
equal values are first counted (combined map-side), then positions are built in two
levels: within a narrow band of values, and over the bands of a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.conditions import present
from freshet.functions.numbers import magnitude_band
from freshet.operators.sizing import SALTS, attach, summarised
from freshet.sources.workspace import stored

ROWS_PER_BAND = 1_000_000
#: Bands of the first count per doubling of the value, and parts a crowded band is cut into.
BANDS_PER_OCTAVE, SUBBANDS = 16, 1024
_LAST_BAND = 2**62


def tally(
    df: DataFrame, keys: Sequence[str], value: str, also: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per (keys, value) with ``rows``, plus any further aggregates."""
    extra = [expr.alias(name) for name, expr in (also or {}).items()]
    return (
        df.withColumn(value, present(F.col(value)))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("rows"), *extra)
    )


def bands_for(rows: int) -> int:
    """How finely to cut: a power of two, enough for one group holding every row
    to have about ``ROWS_PER_BAND`` in each band."""
    return max(16, 2 ** math.ceil(math.log2(max(1, rows / ROWS_PER_BAND))))


def place(
    tallied: DataFrame, keys: Sequence[str], order: Sequence[str], band: Callable[[int], Column]
) -> DataFrame:
    """Add ``below`` (rows ordered before this one) and ``total`` (rows of the group).

    Rows carry their weight in ``rows``. ``band(n)``, for ``n`` from ``bands_for``,
    must not decrease along ``order``. The input is stored first, because it is
    read for both levels and its size decides how finely it is cut.
    """
    keys = list(keys)
    held = summarised(tallied, "to-place")
    banded = held.frame.withColumn("_band", band(bands_for(held.rows)))
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(*earlier)
    across = Window.partitionBy(*keys)
    offsets = (
        banded.groupBy(*keys, "_band")
        .agg(F.sum("rows").alias("_rows"))
        .withColumn("total", F.sum("_rows").over(across))
        .withColumn(
            "_offset",
            F.coalesce(F.sum("_rows").over(across.orderBy("_band").rowsBetween(*earlier)), F.lit(0)),
        )
        .drop("_rows")
    )
    return (
        banded.withColumn("_within", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_band"])
        .withColumn("below", F.col("_within") + F.col("_offset"))
        .drop("_band", "_within", "_offset")
    )


def cumulate(tallied: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``place`` along a numeric column. A missing value sorts last, so it
    counts in ``total`` but never in ``below``."""

    def band(per_octave: int) -> Column:
        return F.coalesce(magnitude_band(F.col(value), per_octave), F.lit(_LAST_BAND))

    return place(tallied, keys, [value], band)


def mean_rank_fraction(value: str) -> Column:
    """Average rank of ties over group size, from ``cumulate`` columns."""
    fraction = (F.col("below") + (F.col("rows") + 1) / 2) / F.col("total")
    return F.when(F.col(value).isNotNull(), fraction)


def attach_by_value(df: DataFrame, ranked: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bring per-(keys, value) results back to the rows they were counted from.

    A single flow value (zero, say) may hold a third of all rows. Values holding
    more than one row in a thousand number fewer than a thousand, so they are
    broadcast; rows they cover, and rows without a value, are spread by content
    and pass through the shuffle join unmatched. Nothing is read twice.
    """
    on = [*keys, value]
    found = [c for c in ranked.columns if c not in on]
    ranked = stored(ranked, "ranked-values")
    everything = ranked.agg(F.sum("rows").alias("n")).scalar()
    hot = ranked.where(F.col("rows") * 1000 > everything).select(
        *on, F.struct(*found).alias("_hot")
    )
    cold = ranked.select(*on, F.struct(*found).alias("_cold"), F.lit(-1).alias("_spread"))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    return (
        df.join(F.broadcast(hot), on, "left")
        .withColumn(
            "_spread",
            F.when(F.col("_hot").isNotNull() | F.col(value).isNull(), spread).otherwise(F.lit(-1)),
        )
        .join(cold, [*on, "_spread"], "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
        .select(*df.columns, *[F.col("_found")[c].alias(c) for c in found])
    )


def _hit(wanted: Mapping[str, Callable[[Column], Column]]) -> Column:
    """Whether a stretch of ``rows`` rows after ``below`` holds a wanted position."""
    inside = [(F.col("below") <= at(F.col("total"))) & (at(F.col("total")) < F.col("below") + F.col("rows")) for at in wanted.values()]
    return reduce(lambda a, b: a | b, inside)


def _running(counts: DataFrame, within: Sequence[str], order: str, base: Column) -> DataFrame:
    """Add ``below``: ``base`` and the rows of smaller bands of the same group."""
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", base + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def _inside(rows: DataFrame, bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that lie in one of their group's bands, with the band; others do not leave the scan.

    A group's bands, a few per wanted position, are one row of the table that is attached."""
    band = F.struct("_least", "_most", F.col("below").alias("_base"), F.col("total").alias("_total"))
    table = summarised(bands.groupBy(*keys).agg(F.collect_list(band).alias("_bands")), "wanted-bands")
    mine = F.try_element_at(F.filter("_bands", lambda b: F.col("_v").between(b["_least"], b["_most"])), F.lit(1))
    held = attach(rows, table, keys).select(*keys, "_v", mine.alias("_band")).where(F.col("_band").isNotNull())
    return held.select(*keys, "_v", "_band.*")


def at_positions(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group, its ``total`` of known values and the values at wanted positions (from 0, as a
    function of the total) in ascending order, one column per name.

    Counts per band of values, combined before they move, tell which bands hold a wanted position.
    Only those are looked into: cut again while one holds more than ``ROWS_PER_BAND`` rows and more
    than one value, then told apart by value. Rows outside wanted bands never pass an exchange, and
    a group whose values lie close together takes further rounds, not a larger task."""
    spread = [F.lit(1).alias("_all")] if not keys else []
    keys, asked = list(keys) or ["_all"], list(keys)
    rows = df.select(*spread, *asked, F.col(value).cast("double").alias("_v")).where(present(F.col("_v")).isNotNull())
    sizes = [F.count(F.lit(1)).alias("rows"), F.min("_v").alias("_least"), F.max("_v").alias("_most")]
    first = rows.groupBy(*keys, magnitude_band(F.col("_v"), BANDS_PER_OCTAVE).alias("_at")).agg(*sizes)
    first = first.withColumn("total", F.sum("rows").over(Window.partitionBy(*keys)))
    bands = stored(_running(first, keys, "_at", F.lit(0)).where(_hit(wanted)).drop("_at"), "bands")
    columns = [*keys, "rows", "_least", "_most", "total", "below"]
    many = (F.col("_least") < F.col("_most")) & (F.col("rows") > ROWS_PER_BAND)
    while not bands.where(many).isEmpty():
        part = F.floor((F.col("_v") - F.col("_least")) / (F.col("_most") - F.col("_least")) * SUBBANDS)
        inside = _inside(rows, bands.where(many), keys).withColumn("_at", F.least(part, F.lit(SUBBANDS - 1)))
        parent = [*keys, "_base", "_total"]
        cut = inside.groupBy(*parent, "_at").agg(*sizes)
        cut = _running(cut, [*keys, "_base"], "_at", F.col("_base")).withColumnRenamed("_total", "total").where(_hit(wanted))
        bands = stored(bands.where(~many).select(*columns).unionByName(cut.select(*columns)), "bands")
    single = bands.where("_least = _most").select(*keys, F.col("_least").alias("_v"), "rows", "below", "total")
    several = bands.where("_least < _most")
    told = _inside(rows, several, keys).groupBy(*keys, "_base", F.col("_total").alias("total"), "_v").agg(F.count(F.lit(1)).alias("rows"))
    told = _running(told, [*keys, "_base"], "_v", F.col("_base")).select(single.columns)
    here = lambda at: (F.col("below") <= at(F.col("total"))) & (at(F.col("total")) < F.col("below") + F.col("rows"))
    picks = [F.max(F.when(here(at), F.col("_v"))).alias(name) for name, at in wanted.items()]
    return single.unionByName(told).groupBy(*keys).agg(F.max("total").alias("total"), *picks).select(*asked, "total", *wanted)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name."""
    position = lambda p, whole: lambda total: whole((total - 1) * F.lit(float(p)))
    wanted = {f"_{name}_{side}": position(p, whole) for name, p in probabilities.items() for side, whole in (("lo", F.floor), ("hi", F.ceil))}
    found = at_positions(df, keys, value, wanted)
    results = []
    for name, p in probabilities.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *results)


