"""What several corpus operators share: the word pattern, written tables, lookups and prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import add, and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

from veilframe.sources import store
from veilframe.sources.store import remove, scratch, settled, shared_dir, ship, table

__all__ = ["remove", "scratch", "settled", "shared_dir", "ship", "table", "written"]

#: ASCII white space, and the characters that make up one word.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A lookup table is broadcast only if a count of its rows and their bytes has shown that it stays under these.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


#: Rows of a batch that a job of these operators sends to Python: whole texts at Spark's 10,000 would fill a worker.
BATCH_ROWS = 512
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send batches of at most BATCH_ROWS rows to Python."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_SETTING)
        else:
            spark.conf.set(_BATCH_SETTING, before)


def small_batches_from_here(spark: SparkSession) -> None:
    """Batches of at most BATCH_ROWS rows for the rest of the session, unless a number is set: for a DataFrame that runs in its caller's job."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, made with small batches."""
    with small_batches(df.sparkSession):
        return store.written(df, label)


def _bytes(name: str, kind: DataType) -> Column:
    """Bytes of a column's value, about."""
    at = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(at), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return 8 * F.greatest(F.size(at), F.lit(0)) + 24
    return F.lit(16)


def lookup(small: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted rows and bytes are few; else joins shuffle it.

    A written table's side of a sort-merge join is a plain exchange, so that
    adaptive execution can split hot keys of the other side. Arrays hold numbers.
    """
    each = reduce(add, [_bytes(f.name, f.dataType) for f in small.schema.fields])
    rows, size = small.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).first()
    return F.broadcast(small) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else small


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join where null keys are equal; right's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """array<string> of the runs of characters that are no ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_count(text: Column) -> Column:
    """Words of a text, without building them: the places where a word begins."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to so many rows and bytes (or one row), so that what is made from their texts stays small."""
    for batch in batches:
        each = max(1, min(rows, batch.num_rows * most_bytes // max(1, batch.get_total_buffer_size())))
        for start in range(0, batch.num_rows, each):
            yield batch.slice(start, each)


class Recent(dict):
    """What make returns for its recent arguments, bounded by bytes and not by entries.

    Two generations, each of up to half of most_bytes: a full one becomes the
    older one, and the older one before it goes, but for arguments that are
    asked for again. Long arguments are never kept. An entry takes about
    entry_bytes and four bytes for each character of its argument.
    """

    LONGEST = 256

    def __init__(self, make: Callable, most_bytes: int, entry_bytes: int) -> None:
        super().__init__()
        self.make, self.most, self.entry = make, most_bytes // 2, entry_bytes
        self.older: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.older[key] if key in self.older else self.make(key)
        if len(key) <= self.LONGEST:
            self.keep_all([(key, value)])
        return value

    def keep_all(self, pairs: Iterable[tuple]) -> None:
        """Keeps (argument, value) pairs of arguments that aren't long and not among the recent ones."""
        for key, value in pairs:
            self.held += self.entry + 4 * len(key)
            if self.held > self.most:
                self.older = dict(self)
                self.clear()
                self.held = self.entry + 4 * len(key)
            self[key] = value
