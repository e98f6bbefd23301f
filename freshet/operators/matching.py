"""Describing predictor names by the closest metric definition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.labels import drop_first
from freshet.operators.sizing import Sized, attach, summarised

PLACEHOLDERS = (r"\[Year\]", r"\[AOI\]")
SPATIAL_UNIT = "Cat|Ws"
# Characters with no special meaning in a regular expression.
_PLAIN = r"^[A-Za-z0-9_ %,:;@#/=<>~&'\"!-]*$"
#: Characters of a required literal that are looked up; a longer one is looked up by its first.
LOOKED_UP = 12
#: Lists over which patterns without a required literal are split.
LISTS = 16
_BREAK = "\u0001"
#: Groups inside groups that are looked through; deeper ones leave a pattern without literal.
GROUP_DEPTH = 6
_LIST = "\u0000list "


def required_literal(pattern: Column) -> Column:
    """The longest text that every match of a regular expression holds, as far as its plain parts tell.

    Escapes, classes, groups and whatever a quantifier makes optional count as unknown; they become
    breaks, and the longest stretch between breaks is the literal. Flags, quotations and classes
    inside classes may change what letters mean: such a pattern has none, nor has one with
    alternatives outside groups."""
    odd = pattern.rlike(r"\(\?|\\Q|\[[^\]]*\[")
    text = F.regexp_replace(pattern, r"\\.", _BREAK)
    text = F.regexp_replace(text, r"\[\^?\]?[^\]]*\]", _BREAK)
    for _ in range(GROUP_DEPTH):
        text = F.regexp_replace(text, r"\([^()]*\)", _BREAK)
    text = F.regexp_replace(text, r".(?:[?*]|\{[^}]*\})", _BREAK)
    stretches = F.split(text, rf"[{_BREAK}.^$+*?{{}}\[\]]+")
    longest = F.array_max(F.transform(stretches, lambda s: F.struct(F.length(s).alias("n"), s.alias("text"))))["text"]
    return F.when(odd | text.rlike(r"[|()]"), F.lit("")).otherwise(longest)


def metric_patterns(definitions: DataFrame) -> DataFrame:
    """Definitions with their placeholders removed (first occurrence of each)."""
    pattern = F.col("metric_name")
    for placeholder in PLACEHOLDERS:
        pattern = drop_first(pattern, placeholder)
    return definitions.withColumn("pattern", pattern)


def _pieces(text: Column, lengths: Sequence[int]) -> Column:
    """Distinct substrings of ``text`` having one of the given lengths."""

    def of_length(n: int) -> Column:
        starts = F.when(
            F.length(text) >= n, F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of_length(n) for n in lengths]))


def matching_definitions(names: DataFrame, patterns: Sized) -> DataFrame:
    """Pairs where a name contains a match of a definition's pattern.

    A plain-text pattern matches where it occurs as a substring, so names are joined on their
    substrings of the lengths in use: an equality join emitting true matches only. A pattern with
    regular-expression syntax is looked up by a literal that each of its matches holds, and tested
    on the names that have it. Patterns without such a literal are dealt to a few lists; only they
    are tested on every name.
    """
    plain = F.col("pattern").rlike(_PLAIN) & (F.col("pattern") != "")
    literal = F.when(plain, F.col("pattern")).otherwise(F.substring(required_literal(F.col("pattern")), 1, LOOKED_UP))
    listed = F.concat(F.lit(_LIST), F.pmod(F.xxhash64("pattern"), F.lit(LISTS)).cast("string"))
    keyed = patterns.frame.withColumns({"_exact": plain, "_literal": literal})
    keyed = summarised(keyed.withColumn("_piece", F.when(F.col("_literal") != "", F.col("_literal")).otherwise(listed)).drop("_literal"), "keyed-patterns")
    is_list = F.col("_piece").startswith(_LIST)
    measured = keyed.frame.agg(
        F.sort_array(F.collect_set(F.when(~is_list, F.length("_piece")))).alias("lengths"),
        F.sort_array(F.collect_set(F.when(is_list, F.col("_piece")))).alias("lists"),
    ).first()
    own = _pieces(F.col("predictor"), measured["lengths"]) if measured["lengths"] else F.array().cast("array<string>")
    lists = F.array(*[F.lit(name) for name in measured["lists"]]).cast("array<string>")
    pieces = names.withColumn("_piece", F.explode(F.concat(own, lists)))
    return (
        attach(pieces, keyed, ["_piece"])
        .where(F.col("_exact") | F.expr("rlike(predictor, pattern)"))
        .drop("_piece", "_exact")
    )


def fuzzy_describe(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """For each predictor the matching definition at the smallest edit distance.

    The name is compared without its first spatial-unit suffix. Predictors that
    match nothing are left out; equal distances go to the first pattern by text.
    The nearest is an aggregate, not a window, so it combines before the shuffle.
    """
    patterns = summarised(
        metric_patterns(definitions).select("pattern", "description"), "metric-patterns"
    )
    bare = drop_first(F.col("predictor"), SPATIAL_UNIT)
    ranked = matching_definitions(names, patterns).select(
        "predictor",
        "importance",
        F.struct(
            F.levenshtein(bare, F.col("pattern")).alias("distance"), "pattern", "description"
        ).alias("candidate"),
    )
    return (
        ranked.groupBy("predictor", "importance")
        .agg(F.min("candidate").alias("best"))
        .select("predictor", "importance", F.col("best.description").alias("description"))
    )


def undescribed(names: DataFrame, described: DataFrame) -> DataFrame:
    """Predictors that found no definition; names are unique on both sides."""
    return names.join(described, "predictor", "left_anti")


def append_literal_rows(described: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """Hand-written rows added by column name, most important first."""
    extra = described.sparkSession.createDataFrame(
        list(rows), "predictor string, importance double, description string"
    )
    return described.unionByName(extra).orderBy(F.desc("importance"), "predictor")


def rank_importance(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "predictor")


def top_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    """The k most important predictors; each task keeps k rows before merging."""
    return rank_importance(importance).limit(k)


def recode(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.replace({old: new}, subset=[column])
