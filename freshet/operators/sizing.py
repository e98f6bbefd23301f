"""Joining a per-key table to a fact table without moving one key to one task.

A broadcast leaves the fact table where it is, but is only right for a table known to be
small. ``Sized`` carries a table together with its counted rows, and ``attach`` broadcasts
below a byte limit. Above it a heavy-hitter summary of the fact table's keys tells which few
are hot; only their rows are dealt to several tasks, and only their table rows repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.sources.workspace import fresh_path

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
#: A key with at least this share of the rows is hot, so there are a thousand of them at most.
HOT_SHARE = 1 / 1000
#: Keys a summary follows; what it misses has fewer rows than a tenth of a hot key.
TRACKED = 10_000


@dataclass(frozen=True)
class Sized:
    """A table, its rows, and the bytes of its texts, binaries and arrays where they were measured."""

    frame: DataFrame
    rows: int
    wide: int | None = None

    @property
    def bytes_in_memory(self) -> int:
        if self.wide is None:
            return self.rows * row_width(self.frame.schema)
        return self.rows * (32 + 16 * len(self.frame.schema.fields)) + self.wide


def row_width(schema: T.StructType) -> int:
    """Bytes one row takes in a hash relation, generously: header + 8 per field,
    and 64 more for each field without a fixed width."""
    return 32 + sum(8 if isinstance(f.dataType, FIXED) else 72 for f in schema.fields)


def counted(table: DataFrame) -> Sized:
    """Size a stored table; a count of a Parquet scan reads footers only."""
    return Sized(table, table.count())


def wide_bytes(schema: T.StructType) -> Column:
    """Bytes of the columns of a row whose width can be measured; others count as in ``row_width``."""
    sizes = [F.lit(0).cast("long")]
    for f in schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            sizes.append(F.coalesce(F.octet_length(column).cast("long"), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            sizes.append(8 * F.coalesce(F.array_size(column).cast("long"), F.lit(0)))
        elif not isinstance(f.dataType, FIXED):
            sizes.append(F.lit(72).cast("long"))
    return reduce(lambda a, b: a + b, sizes)


def summarised(table: DataFrame, name: str) -> Sized:
    """Compute a derived table once, store it, and count its rows and bytes on the way."""
    spark = table.sparkSession
    path = fresh_path(spark, name)
    seen = Observation()
    wide = F.coalesce(F.sum(wide_bytes(table.schema)), F.lit(0)).alias("wide")
    table.observe(seen, F.count(F.lit(1)).alias("rows"), wide).write.parquet(path)
    found = seen.get
    return Sized(spark.read.schema(table.schema).parquet(path), found["rows"], found["wide"])


def hot_keys(fact: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """(``_key``, ``_parts``): hashes of the keys that hold at least ``HOT_SHARE`` of the rows, and over
    how many tasks each is to be dealt: its share of the shuffle's partitions, two at least.

    The summary is of fixed size and made per partition, then merged; a thousand rows come back."""
    spark = fact.sparkSession
    keys = fact.select(F.xxhash64(*on).alias("_key"))
    seen = keys.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_key, {round(1 / HOT_SHARE)}, {TRACKED})").alias("top")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = [(r["item"], max(2, -(-r["count"] * tasks // seen["n"]))) for r in seen["top"] or [] if r["count"] >= max(2, seen["n"] * HOT_SHARE)]
    return spark.createDataFrame(hot, "_key long, _parts int") if hot else None


def attach(
    fact: DataFrame,
    table: Sized,
    on: Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Join ``table`` to ``fact`` on ``on``. ``keys_from`` is a cheaper table with the same keys as
    often as ``fact`` has them, where there is one.

    Above the limit the fact table's hot keys are found in a pass of their own. A row of a hot key
    goes to one of the key's tasks by the partition it comes from: a retried task sends it to the
    same one, and rows that are equal in all columns still spread. A table row of a hot key is
    repeated once per task of that key; all other rows of both sides move once, unchanged.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} would repeat unmatched rows once per task of a hot key")
    on = list(on)
    if table.bytes_in_memory <= limit:
        return fact.join(F.broadcast(table.frame), on, how)
    hot = hot_keys(fact if keys_from is None else keys_from, on)
    if hot is None:
        return fact.join(table.frame, on, how)
    marked = fact.withColumn("_key", F.xxhash64(*on)).join(F.broadcast(hot), "_key", "left")
    dealt = F.coalesce(F.pmod(F.xxhash64(F.spark_partition_id()), F.col("_parts")), F.lit(0)).cast("int")
    salted = marked.withColumn("_salt", dealt).drop("_key", "_parts")
    known = table.frame.withColumn("_key", F.xxhash64(*on)).join(F.broadcast(hot), "_key", "left")
    repeated = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_key", "_parts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
