"""Wide watershed attributes: bundle join, enrichment, flags, column pruning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions.conditions import flag
from freshet.functions.labels import pad_station
from freshet.operators.sizing import Sized, attach, summarised
from freshet.sources.workspace import fresh_path

# Area and coverage columns repeated in every attribute table.
REDUNDANT = (
    "WsAreaSqKm", "CatAreaSqKm", "CatPctFull", "WsPctFull",
    "CatPctFullRp100", "WsPctFullRp100", "WsAreaSqKmRp100", "CatAreaSqKmRp100",
)
# Labels of the published tables.
IMPACT_LABELS = ("Impacted", "Less Impacted")
SOURCE_PRESENCE = ("No WWTP", "WWTP present")
SOURCE_LEVELS = ("Limited", "Higher")
NO_SOURCE = "None"


def bundle_join(
    tables: Sequence[DataFrame],
    key: str = "comid",
    redundant: Sequence[str] = REDUNDANT,
    area: DataFrame | None = None,
) -> DataFrame:
    """Inner-join attribute tables of one row per key, then put areas back.

    Every join is on the same key, so each table is exchanged once and the
    running result keeps its partitioning.
    """
    pruned = [t.drop(*redundant) for t in tables]
    joined = reduce(lambda left, right: left.join(right, key), pruned)
    return joined if area is None else joined.join(area, key)


def co_bucketed(tables: Sequence[DataFrame], key: str = "comid", buckets: int | None = None) -> list[DataFrame]:
    """Tables written once, each bucketed and sorted by ``key`` into the same number of buckets, so
    that they join bucket by bucket without an exchange, now and whenever they are read again.

    The files are in the shared folder; ``buckets`` is the number of shuffle partitions unless given.
    """
    if not tables:
        return []
    spark = tables[0].sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = []
    for table in tables:
        path = fresh_path(spark, "bucketed")
        name = "bucketed_" + path.rsplit("-", 1)[1]
        dealt = table.repartition(buckets, key)  # one file per bucket
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        written.append(spark.table(name))
    return written


def gage_table(raw: DataFrame) -> DataFrame:
    """Gage ids padded to text, catchment key and area; the site name is left out."""
    return raw.select(
        pad_station(F.col("Station_number")).alias("station_number"),
        F.col("COMID").cast("bigint").alias("comid"),
        F.col("Area_Km2").alias("area_km2"),
    )


def tile_density_table(raw: DataFrame) -> DataFrame:
    return raw.select(
        pad_station(F.col("station_ALL_clean")).alias("station_number"),
        F.col("Tile_density").alias("tile_density"),
    )


def station_dimension(gages: DataFrame, attributes: DataFrame, density: DataFrame) -> Sized:
    """Gage, watershed and drainage attributes as one per-station table, so that
    samples are joined once instead of three times."""
    joined = gages.join(attributes, "comid").join(density, "station_number")
    return summarised(joined, "station-attributes")


def enrich_attributes(samples: DataFrame, stations: Sized) -> DataFrame:
    return attach(samples, stations, ["station_number"])


def impact(crop: Column, urban: Column, crop_min: float = 0.5, urban_min: float = 0.1) -> Column:
    return flag((crop >= crop_min) | (urban >= urban_min), *IMPACT_LABELS)


def source_presence(density: Column) -> Column:
    return flag(density == 0, *SOURCE_PRESENCE)


def source_level(density: Column, limited: float = 0.005) -> Column:
    return flag(density < limited, *SOURCE_LEVELS)


def source_category(density: Column, limited: float = 0.005) -> Column:
    return F.when(density == 0, F.lit(NO_SOURCE)).otherwise(source_level(density, limited))


def impact_flags(
    df: DataFrame, crop_min: float = 0.5, urban_min: float = 0.1, limited: float = 0.005
) -> DataFrame:
    density = F.col("wwtp_dens")
    return df.withColumns(
        {
            "impacted": impact(F.col("pct_crop"), F.col("pct_urb_hi"), crop_min, urban_min),
            "wwtp_none": source_presence(density),
            "wwtp_lim": source_level(density, limited),
            "wwtp_category": source_category(density, limited),
        }
    )


def impacted_site_count(samples: DataFrame, excluding: Sequence[str] = ()) -> DataFrame:
    return (
        samples.where(~F.col("station_name").isin(list(excluding)))
        .groupBy("impacted")
        .agg(F.count_distinct("station_name").alias("sites"))
    )


def high_source_sites(df: DataFrame, above: float = 0.005) -> DataFrame:
    return (
        df.where(F.col("wwtp_dens") > above).select("station_name").distinct().orderBy("station_name")
    )


def null_fraction_by_column(df: DataFrame, above: float | None = None) -> DataFrame:
    """Share of missing values per column, from one row of aggregates."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    long = shares.unpivot([], [f"`{c}`" for c in df.columns], "column_name", "null_share")
    return long if above is None else long.where(F.col("null_share") > above)


def drop_all_zero_columns(df: DataFrame) -> DataFrame:
    """Keep columns holding something other than zero, and all non-numeric ones.
    One aggregate row comes back to decide."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    found = df.agg(*[F.max((F.col(f"`{c}`") != 0).cast("int")).alias(c) for c in numeric]).first()
    return df.drop(*[c for c in numeric if found[c] != 1])
