"""The guarded write boundary: strict mode, encryption and the sink in one call; upserts that keep unchanged bytes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.errors import spark_errors
from veilframe.operators.codec import _shaped, decrypt, encrypt, envelope_column, index_of_column
from veilframe.operators.ring import write_ring
from veilframe.plans.audit import require_classified
from veilframe.plans.spec import EntitySpec
from veilframe.sources.keys import KeyProvider


def save(df: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, path: str, *, mode: str = "errorifexists", strict_over: Iterable[EntitySpec] | None = None, sort_by_index: bool = False) -> None:
    """Writes df's stored form as Parquet.

    strict_over: all entities of the catalogue, whose columns must all be
    classified before any job starts. sort_by_index writes files of ranges of
    the first index column, so that their statistics prune searches.
    """
    if strict_over is not None:
        require_classified(strict_over)
    stored = encrypt(df, spec, provider, tenant)
    if sort_by_index and spec.index_columns:
        stored = ranged(stored, _index_only(df, spec, provider, tenant), spec.index_columns[0])
    with spark_errors():
        stored.write.mode(mode).parquet(path)


#: Leading bits of an index by which rows are counted before they are dealt into ranges.
RANGE_BITS = 12


def _index_only(df: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str) -> DataFrame:
    """The first index column of df's stored form; nothing is encrypted for it."""
    return encrypt(df, spec, provider, tenant).select(spec.index_columns[0])


def _leading(index: str) -> Column:
    return F.conv(F.substring(F.hex(F.substring(F.col(f"`{index}`"), 1, 4)), 1, RANGE_BITS // 4), 16, 10).cast("int")


def ranged(stored: DataFrame, indexes: DataFrame, index: str, parts: int | None = None) -> DataFrame:
    """stored in partitions of ascending ranges of an index, of about equal numbers of rows, each sorted by it.

    Indexes are hash values, so counts by their leading bits (2 ** RANGE_BITS
    at most) give the ranges: a value with many rows, or null, is spread over as many
    partitions as its rows fill. No value is computed twice for a sample, as range
    partitioning would.
    """
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")) if parts is None else parts
    counts = {r["lead"]: r["n"] for r in indexes.select(_leading(index).alias("lead")).groupBy("lead").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, before, spans = max(1, sum(counts.values())), 0, []
    for lead in sorted(counts, key=lambda x: -1 if x is None else x):
        first, last = before * parts // total, (before + counts[lead] - 1) * parts // total
        spans.append((-1 if lead is None else lead, first, last - first + 1))
        before += counts[lead]
    table = F.broadcast(stored.sparkSession.createDataFrame(spans, "__lead int, __first int, __width int"))
    own = F.coalesce(_leading(index), F.lit(-1))
    dealt = stored.join(table, own == F.col("__lead"), "left").withColumn("__part", F.coalesce(F.col("__first") + F.pmod(F.monotonically_increasing_id(), F.col("__width")), F.lit(0)).cast("int"))
    return dealt.repartitionById(parts, F.col("__part")).sortWithinPartitions(index).select(*[F.col(f"`{c}`") for c in stored.columns])


def upsert(stored: DataFrame, changes: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, key: str) -> DataFrame:
    """stored with the rows of changes (in plain form, unique by key) put in.

    A column whose plaintext is unchanged keeps its stored bytes; changed and
    new values are encrypted under the current key. Other columns come from
    changes. Only stored rows that a change names are decrypted; the others pass
    as they are. A key that comes twice in changes raises; changes without a
    key, or with a new one, become new rows.
    """
    if not changes.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"a key of the changes comes more than once in {key}")
    named = changes.select(F.col(f"`{key}`").alias("__key")).where("__key is not null")
    untouched = stored.join(named, F.col(f"`{key}`") == F.col("__key"), "left_anti")
    stored = stored.join(named, F.col(f"`{key}`") == F.col("__key"), "left_semi")
    new = {c: F.col(f"`__new_{c}`") for c in changes.columns}
    incoming = changes.select(*[F.col(f"`{c}`").alias(f"__new_{c}") for c in changes.columns], F.lit(True).alias("__given"))
    names = [f.name for f in spec.fields]
    plain = decrypt(stored.select(*stored.columns, *[F.col(f"`{n}`").alias(f"__old_{n}") for n in names]), spec, provider, tenant)
    joined = plain.join(incoming, F.col(f"`{key}`") == new[key], "right")
    joined = joined.crossJoin(write_ring(stored.sparkSession, spec, provider, tenant))
    given = F.col("__given").isNotNull()
    # a projection of its own: an index may need Python, which takes columns; null where nothing changes
    changed = {f"__changed_{i}": given & ~F.col(f"`{f.name}`").eqNullSafe(new[f.name]) for i, f in enumerate(spec.fields)}
    joined = joined.withColumns(changed)
    joined = joined.withColumns({f"__value_{i}": F.when(F.col(f"__changed_{i}"), new[f.name]) for i, f in enumerate(spec.fields)})
    made = {}
    for i, f in enumerate(spec.fields):
        value, is_changed = F.col(f"__value_{i}"), F.col(f"__changed_{i}")
        made[f.name] = F.when(is_changed, envelope_column(value, f, i)).otherwise(F.col(f"`__old_{f.name}`"))
        if f.searchable:
            made[f.index] = F.when(is_changed, index_of_column(value, f, i)).otherwise(F.col(f"`{f.index}`"))
    indexes = set(spec.index_columns)
    for c in stored.columns:
        if c not in made and c not in indexes:
            made[c] = F.when(given, new[c]).otherwise(F.col(f"`{c}`")) if c in new else F.col(f"`{c}`")
    return untouched.unionByName(_shaped(joined, made, spec).select(*stored.columns))


def leaks(stored: DataFrame, plain: DataFrame, spec: EntitySpec, key: str) -> DataFrame:
    """One row (field, leaks): whether any row's stored text holds its own plaintext."""
    names = [f.name for f in spec.fields if f.is_text]
    both = stored.select(key, *names).join(plain.select(F.col(key).alias("__k"), *[F.col(f"`{n}`").alias(f"__p_{n}") for n in names]), F.col(key) == F.col("__k"))
    found = both.agg(*[F.coalesce(F.max(F.col(f"`{n}`").contains(F.col(f"`__p_{n}`")) & (F.col(f"`__p_{n}`") != "")), F.lit(False)).alias(n) for n in names])
    return found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("leaks")) for n in names])).alias("r")).select("r.*")
