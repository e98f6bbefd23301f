"""Benchmark decontamination on a positional inverted index of the training text.

The index has a posting (document, term, position) for every word of the training
text that occurs in the benchmark; other words are in no window. It is written by
the tasks that read the text, so it costs no shuffle.

A benchmark item matches a document along a diagonal: position in the document
minus position in the item. For each window of an item its terms are ordered from
the rarest in training. Postings of rarest terms give the first diagonals, those
of the second rarest thin them out, and what is left is intersected with the
postings of all other terms at their offsets. Where a diagonal is present at
consecutive item words for a window's length, those windows occur exactly.

Proximity matches come from the same lists with ``slack``: a window also counts if
at least ``length - slack`` of its words lie at their offsets.

Defined cases: null texts have no words; an item with fewer words than a window is
one window, one with none is in no document; repeated benchmark rows count as one
item; documents that share an id (or have none) are told apart by their text, and
equal rows get equal answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import lower_ascii, only
from freshet.operators.sizing import attach, counted
from freshet.sources.workspace import stored

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, text and a key that is never null: the id and a digest that tells apart rows sharing it."""
    return only(documents, "doc_id", "text").select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("version"),
    )


def item_terms(benchmark: DataFrame) -> DataFrame:
    """One row per item word: item_id, length of the item, position, term."""
    items = only(benchmark, "item_id", "text").select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    items = items.distinct().withColumn("item", F.xxhash64("item_id", "words"))
    return items.select("item", "item_id", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "term"))


def build_index(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Store the postings (doc, version, position, term_id) of a vocabulary (term, term_id)."""
    terms = identified(documents).select("doc", "version", F.posexplode(words_of(F.col("text"))).alias("position", "term"))
    return stored(attach(terms, counted(vocabulary), ["term"]).select("doc", "version", "position", "term_id"), "postings")


def _windows(terms: DataFrame, length: int) -> DataFrame:
    """Windows with the item positions of their words, rarest in training first."""
    parts = terms.select("item", "n_words", "at", "frequency").withColumn("span", F.least("n_words", F.lit(length)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("span") + 1), F.least(F.col("at"), F.col("n_words") - F.col("span")))
    return (
        parts.withColumn("start", F.explode(starts))
        .groupBy("item", "start", "span")
        .agg(F.sort_array(F.collect_list(F.struct("frequency", "at"))).alias("words"))
        .select("item", "start", "span", F.col("words.at").alias("order"))
    )


def find_matches(postings: DataFrame, terms: DataFrame, length: int = WINDOW, slack: int = 0) -> DataFrame:
    """Diagonals of the index on which windows of items lie.

    ``terms`` is item_terms with term_id and the term's frequency in training. Returns (doc,
    version, item, item_id, diagonal, spans): the spans of item words covered by occurring
    windows, from and to inclusive, one after the other.
    """
    items = terms.select("item", "item_id", "n_words").distinct()
    windows = stored(_windows(terms, length), "windows")

    def lists(nth: int) -> DataFrame:
        """For each window that has so many words, the item position of its nth rarest."""
        chosen = windows.where(F.size("order") > nth).select("item", F.element_at("order", nth + 1).alias("at")).distinct()
        return stored(chosen.join(terms.select("item", "at", "term_id"), ["item", "at"]), "probe")

    def probe(chosen: DataFrame) -> DataFrame:
        met = attach(postings, counted(chosen), ["term_id"])
        return met.select("doc", "version", "item", (F.col("position") - F.col("at")).alias("diagonal"), "at")

    key = ["doc", "version", "item", "diagonal"]
    # with words that may be missing, one of the slack + 1 rarest is present
    seeds = probe(lists(0)).select(*key)
    for nth in range(1, slack + 1):
        seeds = seeds.unionByName(probe(lists(nth)).select(*key))
    found = stored(seeds.distinct(), "diagonals")
    if slack == 0:
        # an item of one word has no second rarest and stays
        single = counted(stored(items.where("n_words = 1").select("item"), "single"))
        second = probe(lists(1)).select(*key).distinct()
        kept = found.join(second, key, "left_semi").unionByName(attach(found, single, ["item"], "left_semi").select(*key))
        found = stored(kept, "diagonals")

    # every word the windows on a surviving diagonal need, looked up in the postings of those documents
    texts = counted(stored(found.select("doc", "version").distinct(), "candidates"))
    near = attach(postings, texts, ["doc", "version"], "left_semi")
    needed = attach(found, counted(stored(terms.select("item", "at", "term_id"), "needed")), ["item"]).select(
        *key, "at", (F.col("diagonal") + F.col("at")).alias("position"), "term_id"
    )
    present = near.join(needed, ["doc", "version", "position", "term_id"]).groupBy(*key).agg(F.sort_array(F.collect_set("at")).alias("at"))
    sized = attach(present, counted(stored(items, "items")), ["item"])
    span = F.least("n_words", F.lit(length))
    starts = F.sequence(F.lit(0), F.col("n_words") - F.col("span"))
    hits = F.when(F.lit(slack) == 0, _runs(F.col("at"))).otherwise(_near(F.col("at"), starts, F.col("span"), slack))
    covered = F.filter(hits, lambda r: r["to"] - r["from"] + 1 >= F.col("span"))
    return sized.withColumn("span", span).withColumn("spans", covered).where("size(spans) > 0").select(*key, "item_id", "spans")


def _runs(at: Column) -> Column:
    """Runs of consecutive numbers of a sorted array, as (from, to)."""
    runs = F.aggregate(
        at,
        F.expr("CAST(array() AS array<struct<`from`:int,`to`:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["to"] == x - 1),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), x.alias("to")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.alias("from"), x.alias("to"))))),
    )
    return runs


def _near(at: Column, starts: Column, span: Column, slack: int) -> Column:
    """Windows with all but ``slack`` of their words in a sorted array, as (from, to)."""
    full = F.filter(starts, lambda s: F.size(F.filter(at, lambda x: (x >= s) & (x < s + span))) >= span - slack)
    return F.transform(full, lambda s: F.struct(s.alias("from"), (s + span - 1).alias("to")))


def _union_length(spans: Column) -> Column:
    """Numbers covered by spans (from, to) sorted by from."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("int").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"] - 1, acc["upto"]))).cast("long").alias("n"),
            F.greatest(acc["upto"], s["to"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def indexed(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings, and the item terms with term_id and frequency."""
    terms = stored(item_terms(benchmark), "item-terms")
    vocabulary = stored(terms.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    postings = build_index(documents, vocabulary)
    counts = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("frequency"))
    known = terms.join(vocabulary, "term").join(counts, "term_id", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    return postings, stored(known, "terms")


def decontaminate(documents: DataFrame, benchmark: DataFrame, length: int = WINDOW, slack: int = 0) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurring window), n_items,
    item_ids (sorted as text) and contaminated."""
    postings, terms = indexed(documents, benchmark)
    matches = find_matches(postings, terms, length, slack)
    spans = F.transform("spans", lambda s: F.struct((s["from"] + F.col("diagonal")).alias("from"), (s["to"] + F.col("diagonal")).alias("to")))
    per_text = matches.groupBy("doc", "version").agg(
        F.sort_array(F.flatten(F.collect_list(spans))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
        F.count_distinct("item").alias("n_items"),
    )
    hits = per_text.select("doc", "version", _union_length(F.col("spans")).alias("n_hit"), "n_items", "item_ids")
    texts = identified(documents).select("doc_id", "doc", "version", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return texts.join(hits, ["doc", "version"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The result with the item ids as a SHA-256 of their comma-joined text."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
