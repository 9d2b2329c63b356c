"""Mixing sources to target weights, with exact budgets and repeated epochs.

Every document gets a hash-random key. Within each source the documents are
sorted by it in hash ranges: a range is one slice of the key space, small
enough for one task, so a source with a third of all rows spreads over many
tasks. Prefix sums are distributed: sizes are summed by range, the range sums
are accumulated by source in a second level, and each range adds its own
running sums. A source's budget covers its first documents wholly and cuts
one; a budget above the source's size takes whole epochs first.

Defined results: a null text has size 0; null sources form one source, ordered
last; a repeated row counts as another document; documents with equal doc_id
are ordered by their text's hash; a source without words has target 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import join_null_safe, lookup, text_or_empty, word_count, written

#: Weights in the sources' order, repeated; share of all words to take; epochs at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Rows of a hash range, about, and ranges of one group of the second level.
RANGE_ROWS = 4_000
GROUP_RANGES = 1_024


def hash_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 random bits from MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares by weight, capped at max_epochs times the size.

    A source is capped if its size per weight is at most the final level: with
    sources in ascending order of size per weight, the capped ones are a
    prefix, and the level is what the rest shares by weight. Both come from
    running sums. The table has one row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights))).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        weighed.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("final_level", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final_level") * F.col("weight")).alias("target"))


def _before(df: DataFrame, value: str, *order: str) -> Column:
    w = Window.partitionBy("source", *order[:-1]).orderBy(*order[-1:]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each document: doc_id, text_hash, size, source, source_size, target, taken.

    taken counts the words that the mix takes: whole epochs, and the rest of
    the budget from the documents that come first in the random order.
    """
    t = text_or_empty(text)
    measured = written(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("text_hash"), word_count(t).alias("size"), F.col(source).alias("source")), "sizes")
    keyed = measured.withColumn("key", hash_key(F.col("doc_id"), seed))
    rows = measured.count()
    bits = max(0, min(40, (max(rows, 1) // RANGE_ROWS).bit_length()))
    ranged = keyed.withColumn("range", F.shiftright("key", 60 - bits)).withColumn("group", F.floor(F.col("range") / GROUP_RANGES))

    sums = written(ranged.groupBy("source", "group", "range").agg(F.sum("size").alias("words")), "ranges")
    groups = sums.groupBy("source", "group").agg(F.sum("words").alias("words"))
    group_starts = groups.withColumn("group_start", _before(groups, "words", "group")).drop("words")
    starts = join_null_safe(sums.withColumn("in_group", _before(sums, "words", "group", "range")), group_starts, ["source", "group"], "inner")
    starts = starts.select("source", "range", (F.col("in_group") + F.col("group_start")).alias("range_start"))
    budgets = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    plan = lookup(written(join_null_safe(starts, budgets, ["source"], "inner"), "plan"))

    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_null_safe(ranged.withColumn("in_range", F.coalesce(F.sum("size").over(inside), F.lit(0))), plan, ["source", "range"], "inner")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.greatest(F.col("source_size"), F.lit(1))))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_start") - F.col("in_range")))
    taken = F.least(epochs * F.col("size") + part, F.lit(max_epochs) * F.col("size")).cast("long")
    return placed.select("doc_id", "text_hash", "size", "source", "source_size", "target", taken.alias("taken"))


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The mixed documents, with docs' columns: a row for each epoch of a document, the cut one with its first words only.

    Documents of which nothing is taken go. Equal rows (id, source and text)
    are taken together: each gets the mean of their taken words.
    """
    taken = mix(docs, text, source, doc_id, **settings).groupBy("doc_id", "source", "text_hash").agg(F.sum("taken").alias("__sum"), F.count(F.lit(1)).alias("__n"), F.max("size").alias("__size"))
    taken = taken.where(F.col("__sum") > 0).withColumnsRenamed({"doc_id": doc_id, "source": source, "text_hash": "__t"})
    t = text_or_empty(text)
    joined = join_null_safe(docs.withColumn("__t", F.xxhash64(t)), written(taken, "taken"), [doc_id, source, "__t"], "inner")
    each = F.floor(F.col("__sum") / F.col("__n"))
    whole, part = F.floor(each / F.col("__size")), each % F.col("__size")
    shares = F.concat(F.array_repeat(F.col("__size"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    spaced = F.regexp_extract_all(F.col(text), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    out = joined.withColumn("__k", F.explode(shares))
    cut = F.col("__k") < F.col("__size")
    out = out.withColumn(text, F.when(cut, F.array_join(F.slice(spaced, 1, F.col("__k").cast("int")), "")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length(F.col(text)).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
