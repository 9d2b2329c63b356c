"""Equality search over encrypted columns by their blind indexes.

A term is normalised and hashed under every key version that the provider
knows, on the driver, when the query is built; so errors show there. The
filter on the index column is an ordinary one that reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.blind_index import index_of
from veilframe.functions.kdf import BLIND_INDEX
from veilframe.plans.spec import EntitySpec, FieldSpec
from veilframe.sources.keys import KeyProvider

#: More index values than this are joined as a table instead of standing in the plan.
INLINE_TERMS = 1_000


def term_indexes(term: str, spec: EntitySpec, f: FieldSpec, provider: KeyProvider, tenant: str) -> list[bytes]:
    """The term's index under each known version."""
    keys = [provider.field_key(tenant, k, BLIND_INDEX, spec.logical, f.logical) for k in provider.known_key_ids(tenant)]
    return [index_of(term, k, f.normalizer) for k in keys]


def where_equals(stored: DataFrame, spec: EntitySpec, name: str, term: str, provider: KeyProvider, tenant: str) -> DataFrame:
    """The rows whose column equals the term after normalising. Calls chain as AND."""
    if term is None:
        raise ValueError("a search term must not be null; find nulls with isNull() on the column")
    return where_in(stored, spec, name, [term], provider, tenant)


def where_in(stored: DataFrame, spec: EntitySpec, name: str, terms: Iterable[str], provider: KeyProvider, tenant: str, hide_terms: bool = False) -> DataFrame:
    """The rows whose column equals any of the terms; none without terms.

    Up to INLINE_TERMS index values are literals that the scan can use.
    hide_terms, or more of them, makes a left semi join with a table instead,
    broadcast by Spark where it is small, so that no value stands in the plan.
    """
    if terms is None:
        raise ValueError("the search terms must not be null")
    f = spec.searchable(name)
    terms = list(terms)
    if any(t is None for t in terms):
        raise ValueError("a search term must not be null")
    values = list(dict.fromkeys(v for t in terms for v in term_indexes(t, spec, f, provider, tenant)))
    if not values:
        return stored.where(F.lit(False))
    if len(values) <= INLINE_TERMS and not hide_terms:
        return stored.where(F.col(f"`{f.index}`").isin([bytearray(v) for v in values]))
    spark = stored.sparkSession
    table = spark.createDataFrame(spark.sparkContext.parallelize([(bytearray(v),) for v in values], max(1, len(values) // 100_000)), T.StructType([T.StructField(f.index, T.BinaryType(), False)]), verifySchema=False)
    return stored.join(table, f.index, "left_semi").select(*stored.columns)


def where_email(stored: DataFrame, spec: EntitySpec, name: str, term: str, provider: KeyProvider, tenant: str) -> DataFrame:
    """where_equals by another name; the column's own normalizer applies."""
    return where_equals(stored, spec, name, term, provider, tenant)
