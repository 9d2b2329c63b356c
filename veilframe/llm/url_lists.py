"""Temporal list join: URL captures against list entries that were active when they were fetched.

List entries are dated: an entry adds a host pattern to the list or off. A pattern's entries become validity intervals, each ending where the
pattern's next entry begins. A capture is looked up by its host and every
parent domain, a host that is an IP address by itself only; at most one interval of a pattern holds a point in time. The
longest matching pattern decides.

The lookup is an as-of join: the distinct (host, time) points and the intervals
of a pattern are sorted together by time, and each point takes the interval
that began last before it, in one pass. A pattern with more than SALT_ROWS
points, such as a host that holds a third of all captures or a listed top-level domain, is dealt into
salts, each of which gets the pattern's intervals.

Defined results: a null or unreadable url has an empty host and matches
nothing; a null time matches nothing; entries with a null pattern or date don't
count; of entries with equal pattern and date, "add" wins; repeated captures
get the same result each; the captures' own columns called host, pattern,
listed_since or blocked give way to those of the result; empty tables are
allowed on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import join_null_safe, lookup, written


#: Points of a pattern that one task sorts, about.
SALT_ROWS = 100_000


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and final dots; empty if there is none. An IPv6 address keeps its brackets."""
    found = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]*)", 1)
    return F.rtrim(found, F.lit("."))


def patterns_of(host: Column) -> Column:
    """The host and its parent domains, the top-level domain included; of an IP address only itself."""
    labels = F.split(host, r"\.")
    address = host.startswith("[") | host.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    return F.when(host == "", F.array().cast("array<string>")).when(address, F.array(host)).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) of entries (pattern, action, at): the spans in which the last entry was an "add"; an open one ends with null."""
    per_date = entries.where("pattern is not null and at is not null").groupBy(F.lower("pattern").alias("pattern"), "at").agg(F.max((F.col("action") == "add").cast("int")).alias("added"))
    nxt = F.lead("at").over(Window.partitionBy("pattern").orderBy("at"))
    return per_date.withColumn("valid_to", nxt).where("added = 1").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def listed(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with host, pattern (the longest active one, else null), listed_since and blocked."""
    captures = captures.drop(*[c for c in captures.columns if c.lower() in ("host", "pattern", "listed_since", "blocked") and c not in (url, at)])
    spans = written(intervals(entries), "intervals")
    hosted = captures.withColumn("host", host_of(F.col(url)))
    points = hosted.select("host", F.col(at).alias("__at")).where("host <> '' and __at is not null").distinct()
    keys = points.select("host", "__at", F.explode(patterns_of(F.col("host"))).alias("pattern"))
    keys = written(keys.join(lookup(written(spans.select("pattern").distinct(), "patterns")), "pattern", "left_semi"), "points")
    hot = keys.groupBy("pattern").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts")).where("salts > 1")
    hot = lookup(written(hot, "hot"))
    salted = keys.join(hot, "pattern", "left").select("pattern", F.pmod(F.xxhash64("host", "__at"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.col("__at").alias("t"), "host")
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    began = spans.join(hot, "pattern", "left").select("pattern", F.explode(salts).alias("salt"), F.col("valid_from").alias("t"), F.struct("valid_from", "valid_to").alias("span"))
    events = began.withColumn("host", F.lit(None).cast("string")).unionByName(salted.withColumn("span", F.lit(None).cast(began.schema["span"].dataType)))
    before = Window.partitionBy("pattern", "salt").orderBy("t", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = events.withColumn("span", F.last("span", ignorenulls=True).over(before)).where("host is not null and span is not null")
    active = held.where(F.col("span.valid_to").isNull() | (F.col("t") < F.col("span.valid_to")))
    longest = active.groupBy("host", "t").agg(F.max(F.struct(F.char_length("pattern").alias("n"), "pattern", F.col("span.valid_from").alias("listed_since"))).alias("m"))
    verdicts = lookup(written(longest.select("host", F.col("t").alias("__at"), "m.pattern", "m.listed_since"), "verdicts"))
    joined = join_null_safe(hosted.withColumn("__at", F.col(at)), verdicts, ["host", "__at"], "left").drop("__at")
    return joined.withColumn("blocked", F.col("pattern").isNotNull())
