"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. Its expected copies per document,
target over size, split into whole copies, which every document gets for certain,
and a remainder, the inclusion odds of one copy more. Documents are ranked by
random odds over inclusion odds, u/(1-u) : p/(1-p), with u from a digest of the
document's id, and the best ranked are taken until the source's target is met: of
the sizes around it, the nearer one.

The rank's cut is found without ordering a source. Ranks are mapped to [0, 1) and
read as two digits of 12 bits: words are counted per first digit, then per second
digit inside the one digit where the target falls, and the documents that share both
digits (a 16-millionth of a source, and whatever repeats one of their ids) are counted
per id and size; only these counts are put in order. Of equal rows at the cut as many are
taken as still fit, those with the smallest hashes of a row number that is stored with
the sizes: rows are counted per 16-bit head of the hash, and one head's rows are ordered.

Defined cases: a null source is a source, the last; null or empty texts have size
0 and take 0 words; a null id is ranked by its text; repeated rows are ranked
together (same rank) and taken or left one by one, the target ending among them; a
source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import SPACES
from freshet.operators.sizing import attach, counted
from freshet.sources.workspace import stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
DIGIT = 4096
HEAD_BITS = 16


def size_of(text: Column) -> Column:
    """Words of a text: runs of other characters than white space."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that every run repeats: 52 bits of a digest of the id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sources: DataFrame, weights: Sequence[int], total_share: float, most: int) -> DataFrame:
    """Per source (source, source_size): its target. Sharing out the excess again and again ends
    with the sources of the smallest room per weight at their limit and one rate for the rest."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = (
        sources.withColumn("weight", weight.cast("long"))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("room", F.col("limit") / F.col("weight"))
        .withColumn("words_left", F.sum("source_size").over(everything) * F.lit(total_share) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("rate", F.col("words_left") / F.col("weight_left"))
    )
    # the first source in order of room that stays under its limit gives everyone's rate
    rate = F.min(F.when(F.col("room") > F.col("rate"), F.struct("room", "rate"))).over(everything)["rate"]
    return filled.withColumn("shared", rate).select(
        "source",
        "source_size",
        F.when(F.col("shared").isNotNull() & (F.col("room") > F.col("shared")), F.col("weight") * F.col("shared"))
        .otherwise(F.col("limit").cast("double"))
        .alias("target"),
    )


def _crossing(sized: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """Per source, the digit in which the wanted words are reached, with the words ranked before it.
    ``sized`` has the keys, wanted and size; a source has at most 4096 digits here."""
    per_digit = sized.groupBy(*keys, digit, "wanted").agg(F.sum("size").alias("words"))
    ranked = Window.partitionBy(*keys).orderBy(digit)
    upto = F.sum("words").over(ranked)
    return (
        per_digit.withColumn("upto", upto)
        .where("upto >= wanted")
        .groupBy(*keys)
        .agg(F.min(F.struct(digit, (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        .select(*keys, F.col(f"at.{digit}").alias(f"{digit}_cut"), F.col("at.before").alias(f"{digit}_before"))
    )


def _ties(inside: DataFrame, last: DataFrame) -> DataFrame:
    """Per source whose target falls among equal rows, the hash and number of the last one taken."""
    spread = F.xxhash64("row")
    equal = attach(inside, counted(last.where("fit < n")), ["name"]).where("place = last.place AND doc_id <=> last.doc_id AND size = last.size")
    equal = equal.select("name", "fit", "row", spread.alias("hash"), F.shiftrightunsigned(spread, 64 - HEAD_BITS).alias("head"))
    equal = stored(equal, "mix-equal")
    heads = equal.groupBy("name", "head", "fit").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("name").orderBy("head"))
    heads = heads.withColumn("upto", upto).where("upto >= fit AND upto - rows < fit").select("name", "head", (F.col("fit") - F.col("upto") + F.col("rows")).alias("take"))
    nth = F.row_number().over(Window.partitionBy("name", "head").orderBy("hash", "row"))
    cut = attach(equal, counted(stored(heads, "mix-heads")), ["name", "head"]).withColumn("nth", nth).where("nth = take")
    return cut.select("name", F.struct("head", "hash", "row").alias("tie"))


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    total_share: float = 1.0,
    most: int = MOST_COPIES,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies and taken, and a struct ``carried``
    of the columns named, if any: a row's own, whatever ids it shares.

    Sources in code point order, null last, weigh ``weights`` in turn; their targets share
    ``total_share`` of all words, none above ``most`` times its own words.
    """
    kept = [F.struct(*(F.col(f"`{c}`") for c in carried)).alias("carried")] if carried else []
    rows = documents.select(
        "doc_id",
        "source",
        size_of(F.col("text")).alias("size"),
        uniform(F.col("doc_id"), F.col("text")).alias("u"),
        F.monotonically_increasing_id().alias("row"),
        *kept,
    )
    rows = stored(rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), "mix-sizes")
    sources = rows.groupBy("name", "source").agg(F.sum("size").alias("source_size"))
    wanted = stored(targets(sources, weights, total_share, most), "mix-targets").withColumn(
        "name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    )
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.select("name", "source_size", "target", F.floor(share).alias("whole"), (share - F.floor(share)).alias("p")).withColumn(
        "wanted", F.col("target") - F.col("whole") * F.col("source_size")
    )
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    place = F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(0.0)
    ranked = (
        attach(rows, counted(stored(wanted, "mix-shares")), ["name"])
        .withColumn("place", place)
        .withColumn("first", F.least(F.floor(F.col("place") * DIGIT), F.lit(DIGIT - 1)))
        .withColumn("second", F.pmod(F.floor(F.col("place") * (DIGIT * DIGIT)), F.lit(DIGIT)))
    )
    cut = counted(stored(_crossing(ranked.where("wanted > 0"), ["name"], "first"), "mix-first"))
    slim = ranked.select("name", "doc_id", "size", "row", "place", "first", "second", "wanted")
    inside = attach(slim.where("wanted > 0"), cut, ["name"]).where("first = first_cut")
    inside = stored(inside.withColumn("wanted", F.col("wanted") - F.col("first_before")), "mix-inside")
    second = counted(stored(_crossing(inside, ["name"], "second"), "mix-second"))
    edge = attach(inside, second, ["name"]).where("second = second_cut").withColumn("wanted", F.col("wanted") - F.col("second_before"))
    groups = edge.groupBy("name", "place", "doc_id", "size", "wanted").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("name").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("left", F.col("wanted") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(in_order), F.lit(0)))
    # up to the target, and over it by one document if that is nearer
    fit = F.when(F.col("size") > 0, F.floor(F.col("left") / F.col("size") + 0.5)).when(F.col("left") >= 0, F.col("n")).otherwise(0)
    last = (
        groups.withColumn("fit", F.least(F.col("n"), fit))
        .where("fit > 0")
        .groupBy("name")
        .agg(F.max(F.struct("place", "doc_id", "size", "fit", "n")).alias("last"))
        .select("name", F.struct("last.place", "last.doc_id", "last.size").alias("last"), "last.fit", "last.n")
    )
    last = stored(last, "mix-last")
    limits = cut.frame.join(second.frame, "name", "left").join(last, "name", "left").join(_ties(inside, last), "name", "left")
    limits = counted(stored(limits.select("name", "first_cut", "second_cut", "last", "tie"), "mix-limits"))
    here = F.struct("place", F.col("doc_id"), F.col("size"))
    there = F.struct("last.place", "last.doc_id", "last.size")
    spread = F.xxhash64("row")
    mine = F.struct(F.shiftrightunsigned(spread, 64 - HEAD_BITS).alias("head"), spread.alias("hash"), F.col("row"))
    in_sample = (
        F.when(F.col("wanted") <= 0, False)
        .when(F.col("first_cut").isNull(), True)
        .when(F.col("first") != F.col("first_cut"), F.col("first") < F.col("first_cut"))
        .when(F.col("second_cut").isNull(), True)
        .when(F.col("second") != F.col("second_cut"), F.col("second") < F.col("second_cut"))
        .when(F.col("last").isNull(), False)
        .when(here < there, True)
        .when(here > there, False)
        .when(F.col("tie").isNull(), True)
        .otherwise(mine <= F.col("tie"))
    )
    copies = F.col("whole") + F.when((F.col("size") > 0) & in_sample, 1).otherwise(0)
    return (
        attach(ranked, limits, ["name"], "left")
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["carried"] if carried else []))
    )
