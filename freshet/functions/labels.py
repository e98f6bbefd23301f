"""Identifier and label text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: raw station ids are read to this width.
RAW_ID_WIDTH = 14
SHORT_LABEL_WIDTH = 7


def strip_prefix_letter(raw_id: Column, width: int = RAW_ID_WIDTH) -> Column:
    """Characters 2..width of a raw station id."""
    return F.substring(raw_id, 2, width - 1)


def short_label(name: Column, width: int = SHORT_LABEL_WIDTH) -> Column:
    return F.substring(name, 1, width)


def pad_station(number: Column) -> Column:
    """Zero-pad to eight digits; longer ids stay whole (``lpad`` would cut them), missing ones missing."""
    whole = number.try_cast("bigint")
    return F.when(whole.isNotNull(), F.format_string("%08d", whole))


def drop_text(value: Column, text: str) -> Column:
    """Remove every occurrence of a literal."""
    return F.replace(value, F.lit(text), F.lit(""))


def spaces_to_lines(value: Column) -> Column:
    return F.regexp_replace(value, r"\s", "\n")


def drop_first(value: Column, pattern: str) -> Column:
    """Remove only the first match of a regular expression."""
    return F.regexp_replace(value, f"(?s)^(.*?)(?:{pattern})", "$1")


def relabel(code: Column, labels: Mapping) -> Column:
    """Code to label; NULL for a code that is not listed."""
    chain = F
    for key, label in labels.items():
        chain = chain.when(code == F.lit(key), F.lit(label))
    return chain


def significance_label(p: Column, digits: int = 2, below: float = 0.001) -> Column:
    """Text of a rounded p value. The comparison sees the rounded number."""
    rounded = F.round(p, digits)
    small = F.lit(f"<{below:g}")
    return F.when(rounded < below, small).when(rounded >= below, rounded.cast("string"))
