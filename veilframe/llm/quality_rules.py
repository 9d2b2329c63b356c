"""Quality rules: per-text counts and the frequency of lines across the documents of a host.

The lines of a text are normalised (ASCII white space runs become one space,
ends trimmed, lower case) and hashed. For each host the number of distinct
documents that hold a line is counted, where documents with equal texts count
once. A line is over its limit when more than
``max(min_documents, max_share * distinct documents of the host)`` hold it.
Such lines are removed, and a document is depleted when they held more than
``max_removed`` of its words.

Defined results: a null text counts as empty; null hosts form one host; rows
with equal host and text get equal verdicts, also if their doc_id repeats or
is null; an empty table gives an empty result. ``clean`` returns docs' own
columns, whatever their names, and touches only the text and n_chars.
``text_rules`` and ``judge`` add columns, to which docs' own columns of these
names give way.

Everything is DataFrame expressions. Lines reach a shuffle only as partial
counts by (host, hash). They are hashed once, into a written table. The lines
over a limit are few (at most all lines divided by ``min_documents``) and are
joined back, broadcast when their rows and bytes are few and else by a join
that can split hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import SPACE_CHARS, SPACES, join_null_safe, lookup, text_or_empty, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Limits of the cross-document rule.
MIN_DOCUMENTS = 8
MAX_SHARE = 0.02
MAX_REMOVED = 0.5


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of 8 words which occurs twice or more in the text.

    Window hashes come from three doublings of word hashes. Only texts with a
    repeated window sort their (hash, place) pairs.
    """

    def doubled(hashes: Column, step: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def covered(pairs: Column) -> Column:
        same = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
        at = F.array_sort(F.transform(F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
        gaps = let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def of_windows(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = let(let(let(hashed, lambda h: doubled(h, 1)), lambda h: doubled(h, 2)), lambda h: doubled(h, 4))
    complete = let(windows, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0))))
    return F.when(F.size(tokens) < window + 1, F.lit(0)).otherwise(let(complete, of_windows))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
VERDICT = ("n_removed_words", "over_lines", "kept")


def _without(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return docs.drop(*[c for c in docs.columns if c.lower() in {*names, "__w", "__t"}])


def text_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of RULES."""
    docs = _without(docs, RULES)
    t = text_or_empty(text)
    chars = F.char_length(t)
    counts = docs.withColumn(
        "__w",
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))),
    ).withColumns(
        {
            "n_words": F.col("__w.n"),
            "word_chars": F.char_length(F.translate(t, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (chars - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": duplicate_lines(t).cast("long"),
            "n_repeat_words": F.col("__w.r"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counts.drop("__w").withColumn("base_failed", failed)


def normalised_lines(text: Column) -> Column:
    """The normalised form of every line, empty ones included, in order."""
    flat = F.lower(F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " "))
    return F.transform(F.split(flat, "\n"), lambda x: F.btrim(x))


def _lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """A row for each line with a word: host, text_hash, its place i, line (its hash) and its words w."""
    t = text_or_empty(text)
    pairs = F.transform(
        normalised_lines(t),
        lambda x: F.struct(F.xxhash64(x).alias("line"), F.when(x == "", F.lit(0)).otherwise(F.size(F.split(x, " "))).alias("w")),
    )
    return (
        docs.select(F.col(host).alias("host"), F.xxhash64(t).alias("text_hash"), F.posexplode(pairs).alias("i", "p"))
        .where(F.col("p.w") > 0)
        .select("host", "text_hash", "i", "p.line", "p.w")
    )


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, text_hash, line, w): the lines over their limit in each distinct document, w the words of all their places there.

    A first count of occurrences, with partial sums, can only be too high. It
    leaves few candidate lines, whose distinct documents are then counted.
    """
    lines = written(_lines(docs, text, host), "lines")
    hosts = lookup(
        written(
            docs.select(F.col(host).alias("host"), F.xxhash64(text_or_empty(text)).alias("t")).groupBy("host").agg(F.count_distinct("t").alias("n_documents")),
            "hosts",
        )
    )
    limit = F.greatest(F.lit(float(min_documents)), F.lit(max_share) * F.col("n_documents"))
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_documents)
    candidates = lookup(written(join_null_safe(counted, hosts, ["host"], "inner").where(F.col("n") > limit).select("host", "line"), "candidates"))
    placed = join_null_safe(lines, candidates, ["host", "line"], "inner").groupBy("host", "text_hash", "line", "i").agg(F.max("w").alias("w"))
    hits = written(placed.groupBy("host", "text_hash", "line").agg(F.sum("w").alias("w")), "hits")
    held = hits.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    over = lookup(written(join_null_safe(held, hosts, ["host"], "inner").where(F.col("n") > limit).select("host", "line"), "over"))
    return join_null_safe(hits, over, ["host", "line"], "inner").select("host", "text_hash", "line", "w")


def _removals(docs: DataFrame, text: str, host: str, **limits) -> DataFrame:
    """(host, text_hash): the lines to remove from that text and their words there."""
    found = frequent_lines(docs, text, host, **limits)
    return lookup(written(found.groupBy("host", "text_hash").agg(F.collect_list("line").alias("over_lines"), F.sum("w").alias("n_removed_words")), "removals"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_removed: float = MAX_REMOVED, **limits) -> DataFrame:
    """docs with the counts of ``text_rules``, n_removed_words, over_lines (hashes, null: none) and kept."""
    docs = _without(docs, RULES + VERDICT)
    removals = _removals(docs, text, host, **limits).withColumnsRenamed({"host": host, "text_hash": "__t"})
    ruled = text_rules(docs, text).withColumn("__t", F.xxhash64(text_or_empty(text)))
    joined = join_null_safe(ruled, removals, [host, "__t"], "left").drop("__t")
    removed = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    depleted = removed > F.lit(max_removed) * F.col("n_words")
    return joined.withColumn("n_removed_words", removed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept documents, without their lines over the limit, with docs' columns (n_chars follows the text if there)."""
    rest = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    packed = docs.select(rest.alias("__doc"), F.col(text).alias("__text"), F.col(host).alias("__host"))
    judged = judge(packed, "__text", "__host", **limits).where("kept")
    kept_lines = let(
        F.struct(F.split(F.col("__text"), "\n").alias("raw"), normalised_lines(F.col("__text")).alias("norm")),
        lambda x: F.array_join(F.filter(x["raw"], lambda line, i: ~F.array_contains(F.col("over_lines"), F.xxhash64(F.get(x["norm"], i)))), "\n"),
    )
    whole = F.col("over_lines").isNull()
    out = judged.select("__doc", "over_lines", F.when(whole, F.col("__text")).otherwise(kept_lines).alias("__text"))
    n_chars = F.char_length("__text").cast("long")
    own = {c: F.col("__doc").getField(c) for c in docs.columns if c != text} | {text: F.col("__text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(whole, own["n_chars"]).otherwise(n_chars)
    return out.select(*[own[c].alias(c) for c in docs.columns])
