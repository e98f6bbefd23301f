"""Six unequal seasons; early winter wraps the turn of the year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season names in display order, with their months.
SEASON_MONTHS = {
    "Early Winter": (11, 12, 1),
    "Late Winter": (2, 3),
    "Spring": (4, 5),
    "Early Summer": (6, 7),
    "Late Summer": (8, 9),
    "Fall": (10,),
}
SEASONS = tuple(SEASON_MONTHS)


def season_of(month: Column) -> Column:
    """Season name of a month number, NULL outside 1-12."""
    chain = F
    for name, months in SEASON_MONTHS.items():
        chain = chain.when(month.isin(*months), F.lit(name))
    return chain


def level_order(value: Column, levels=SEASONS) -> Column:
    """1-based place of a label in its declared order, NULL if undeclared."""
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
    return F.when(place > 0, place).cast("int")
