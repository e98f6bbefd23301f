"""Three-valued helpers: a missing input must give a missing answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(test: Column, yes, no) -> Column:
    """``yes`` / ``no`` by ``test``; NULL where the test itself is NULL.

    ``when(test).otherwise(no)`` would turn a missing test into ``no``.
    """
    return F.when(test, F.lit(yes)).when(~test, F.lit(no))


def unless_missing(aggregate: Callable[[Column], Column], value: Column) -> Column:
    """An aggregate that is NULL as soon as one row of the group lacks the value."""
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate(value))


def present(value: Column) -> Column:
    """A double with NaN read as missing."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def sole_value(value: Column) -> Column:
    """The one value a column takes within a group; an error if it takes two."""
    single = F.min(value).eqNullSafe(F.max(value)) & F.count(value).isin(F.lit(0), F.count(F.lit(1)))
    return F.when(single, F.min(value)).otherwise(
        F.raise_error(F.lit("a column expected to be constant within its group is not"))
    )
