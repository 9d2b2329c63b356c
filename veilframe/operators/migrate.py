"""Key rotation: which stored values are under older keys, and re-encrypting them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.envelope import checked, let, parse
from veilframe.operators.codec import _shaped, envelope_bytes, envelope_column, index_of_column, plain_bytes
from veilframe.operators.ring import RING, read_ring, write_ring
from veilframe.plans.spec import EntitySpec, FieldSpec
from veilframe.sources.keys import KeyProvider
from veilframe.sources.store import settled, written

DEFAULT_BATCH = 500


def stored_key_id(value: Column, f: FieldSpec) -> Column:
    """The key id in a stored value's header, without any key; null stays null, bytes that are no envelope raise."""
    return let(checked(let(envelope_bytes(value, f), parse)), lambda p: p["key_id"])


def needs_reencryption(value: Column, f: FieldSpec, current_key_id: bytes) -> Column:
    """Whether a value is under another key than the current one; false for null."""
    return F.coalesce(stored_key_id(value, f) != F.lit(current_key_id), F.lit(False))


def migration_plan(stored: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, column: str = "plan") -> DataFrame:
    """stored with an array of (field, stored_key_id, current_key_id) of the fields under older keys, in the entity's order, and requires_migration."""
    current = provider.current_key_id(tenant)
    found = [
        F.struct(F.lit(f.name).alias("field"), stored_key_id(F.col(f"`{f.name}`"), f).alias("stored_key_id"), F.lit(current).alias("current_key_id"))
        for f in spec.fields
    ]
    plan = F.filter(F.array(*found), lambda p: p["stored_key_id"].isNotNull() & (p["stored_key_id"] != p["current_key_id"]))
    return stored.withColumn(column, plan).withColumn("requires_migration", F.size(column) > 0)


def reencrypt(stored: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str) -> DataFrame:
    """stored with every value under the current key, indexes too; values that are there already keep their bytes."""
    spark = stored.sparkSession
    read = read_ring(spark, spec, provider, tenant, list(spec.fields)).withColumnRenamed(RING, "__read")
    joined = stored.crossJoin(read).crossJoin(write_ring(spark, spec, provider, tenant).withColumnRenamed(RING, "__write"))
    current = provider.current_key_id(tenant)
    merged = joined.withColumn(RING, F.struct("__read.*", "__write.*")).drop("__read", "__write")
    opened: dict[str, Column] = {}
    for i, f in enumerate(spec.fields):
        value = F.col(f"`{f.name}`")
        old = needs_reencryption(value, f, current)
        plain = plain_bytes(value, f, i)
        opened[f"__plain_{i}"] = F.when(old, F.decode(plain, "UTF-8") if f.is_text else plain)
    # a projection of its own: an index may need Python, which takes columns; null where nothing changes
    ready = merged.withColumns(opened)
    made: dict[str, Column] = {}
    for i, f in enumerate(spec.fields):
        text = F.col(f"__plain_{i}")
        made[f.name] = F.when(text.isNotNull(), envelope_column(text, f, i)).otherwise(F.col(f"`{f.name}`"))
        if f.searchable:
            made[f.index] = F.when(text.isNotNull(), index_of_column(text, f, i)).otherwise(F.col(f"`{f.index}`"))
    return _shaped(ready, made, spec).select(*stored.columns)


@dataclass(frozen=True)
class BatchOptions:
    """How many rows a batch takes."""

    batch_size: int = DEFAULT_BATCH

    def __post_init__(self) -> None:
        if self.batch_size <= 0:
            raise ValueError("a batch has at least one row")


@dataclass(frozen=True)
class ResumeToken:
    """Where to go on: an opaque, non-blank cursor."""

    cursor: str

    def __post_init__(self) -> None:
        if not self.cursor or not self.cursor.strip():
            raise ValueError("a cursor must not be blank")

    def __str__(self) -> str:
        return self.cursor


@dataclass(frozen=True)
class BatchResult:
    """What one batch did."""

    migrated: int = 0
    skipped: int = 0
    failed: int = 0
    next: ResumeToken | None = None

    def __post_init__(self) -> None:
        if min(self.migrated, self.skipped, self.failed) < 0:
            raise ValueError("counts are not negative")

    @property
    def processed(self) -> int:
        return self.migrated + self.skipped + self.failed

    @property
    def has_more(self) -> bool:
        return self.next is not None


@dataclass(frozen=True)
class Progress:
    """Totals over batches."""

    migrated: int = 0
    skipped: int = 0
    failed: int = 0
    batches: int = 0
    token: ResumeToken | None = None
    is_complete: bool = False

    @property
    def processed(self) -> int:
        return self.migrated + self.skipped + self.failed

    def after(self, batch: BatchResult) -> Progress:
        return replace(
            self, migrated=self.migrated + batch.migrated, skipped=self.skipped + batch.skipped, failed=self.failed + batch.failed, batches=self.batches + 1, token=batch.next, is_complete=not batch.has_more
        )


def _after(stored: DataFrame, key: str, start: ResumeToken | None) -> DataFrame:
    return stored if start is None else stored.where(F.col(key) > F.lit(start.cursor).cast(stored.schema[key].dataType))


def _any_old(spec: EntitySpec, provider: KeyProvider, tenant: str) -> Column:
    """Whether any field of a row is under an older key."""
    current, old = provider.current_key_id(tenant), F.lit(False)
    for f in spec.fields:
        old = old | needs_reencryption(F.col(f"`{f.name}`"), f, current)
    return old


def batches(stored: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, key: str, options: BatchOptions = BatchOptions(), start: ResumeToken | None = None) -> Iterator[tuple[DataFrame, BatchResult]]:
    """An extension: re-encrypted rows in batches by a unique, ordered key column, from a cursor on. The caller writes each.

    Each batch has jobs of its own over the whole table, for stores that take a
    few rows at a time. For tables of a cluster's size use planned and resumed,
    which do all batches in a few jobs, or reencrypt, which has no batches.
    """
    kind = stored.schema[key].dataType
    cursor = start
    while True:
        part = _after(stored, key, cursor).orderBy(key).limit(options.batch_size)
        old = _any_old(spec, provider, tenant)
        n, migrated, last = part.agg(F.count(F.lit(1)), F.coalesce(F.sum(old.cast("int")), F.lit(0)), F.max(key).cast("string")).first()
        more = n == options.batch_size and not stored.where(F.col(key) > F.lit(last).cast(kind)).isEmpty()
        cursor = ResumeToken(last) if more else None
        yield reencrypt(part, spec, provider, tenant), BatchResult(migrated=migrated, skipped=n - migrated, next=cursor)
        if cursor is None:
            return


#: Bits of monotonically_increasing_id that count within a partition.
_PLACE_BITS = 33


def planned(stored: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, key: str, options: BatchOptions = BatchOptions(), start: ResumeToken | None = None) -> list[BatchResult]:
    """The results of all batches from a cursor on, without their rows, from keys and headers in a few jobs; none for no rows.

    Keys are sorted in ranges; a key's place is that in its range, after the
    ranges before, so no task sees all keys. The driver gets a row for each
    range and for each batch.
    """
    spark = stored.sparkSession

    def made() -> DataFrame:
        # written before the ranges are sampled, so that headers are parsed once
        keys = written(_after(stored, key, start).select(F.col(f"`{key}`").alias("key"), _any_old(spec, provider, tenant).alias("old")), "keys")
        placed = written(keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("place", F.monotonically_increasing_id()), "places")
        placed = placed.select("key", "old", F.shiftright("place", _PLACE_BITS).alias("range"), F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"))
        ahead, spans = 0, []
        for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():
            spans.append((r["range"], ahead))
            ahead += r["n"]
        ranges = F.broadcast(spark.createDataFrame(spans, "range long, ahead long"))
        batch = F.floor((F.col("ahead") + F.col("place")) / F.lit(options.batch_size))
        return placed.join(ranges, "range").groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if("old").alias("migrated"), F.max("key").cast("string").alias("last"))

    found = settled(spark, made, "plan").orderBy("batch").collect()
    return [BatchResult(migrated=r["migrated"], skipped=r["n"] - r["migrated"], next=ResumeToken(r["last"]) if i < len(found) else None) for i, r in enumerate(found, 1)]


def resumed(stored: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, key: str, tokens: Sequence[ResumeToken | None], column: str = "batch") -> DataFrame:
    """Many batches at once: re-encrypted rows, with the number of their batch, which counts tokens from 1. The caller writes them.

    A batch has the rows after its token (None: from the first row on), up to the
    next token's row; rows up to the first token are left out. Rows and tokens are
    sorted together in ranges of the key, and a range begins with the
    batch in which the one before ended.
    """
    if column in stored.columns:
        raise ValueError(f"there is a column {column} already")
    spark, kind, order = stored.sparkSession, stored.schema[key].dataType, ("key", "mark")

    def made() -> DataFrame:
        starts = spark.createDataFrame([(None if t is None else t.cursor, i) for i, t in enumerate(tokens, 1)], "cursor string, batch long")
        # a token follows its row, the start comes before a null key
        starts = starts.select(F.col("cursor").cast(kind).alias("key"), F.when(F.col("cursor").isNull(), F.lit(-1)).otherwise(F.lit(1)).alias("mark"), "batch")
        keys = stored.select(F.col(f"`{key}`").alias("key"), F.lit(0).alias("mark"), F.lit(None).cast("long").alias("batch"))
        ranged = written(keys.union(starts).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
        carried, spans = None, []
        for r in ranged.groupBy("range").agg(F.max_by("batch", F.when(F.col("mark") != 0, F.struct(*order))).alias("last")).orderBy("range").collect():
            spans.append((r["range"], carried))
            carried = carried if r["last"] is None else r["last"]
        ranges = F.broadcast(spark.createDataFrame(spans, "range int, carried long"))
        latest = F.last("batch", ignorenulls=True).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        of_rows = ranged.withColumn("batch", latest).where("mark = 0").join(ranges, "range")
        return of_rows.select(F.col("key").alias("__key"), F.coalesce("batch", "carried").alias(column)).where(F.col(column).isNotNull()).dropDuplicates(["__key"])

    dealt = settled(spark, made, "dealt")
    joined = stored.join(dealt, F.col(f"`{key}`").eqNullSafe(F.col("__key"))).drop("__key")
    return reencrypt(joined, spec, provider, tenant)
