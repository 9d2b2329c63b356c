"""Key rings: working keys as one-row tables that queries join.

Keys are never literals, so no plan, log or UI shows them, and Catalyst can't
fold an encryption into a constant. A ring has one row, whatever the data, so
its broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.envelope import associated_data, header_bytes
from veilframe.functions.kdf import BLIND_INDEX, ENCRYPTION, hmac_pads
from veilframe.plans.spec import EntitySpec, FieldSpec
from veilframe.sources.keys import KeyProvider

RING = "__ring"


def _one_row(spark: SparkSession, values: dict[str, tuple[T.DataType, object]]) -> DataFrame:
    schema = T.StructType([T.StructField(k, t, False) for k, (t, _) in values.items()])
    rows = spark.sparkContext.parallelize([tuple(v for _, v in values.values())], 1)  # an RDD: a local relation would print its values
    frame = spark.createDataFrame(rows, schema, verifySchema=False)
    return F.broadcast(frame.select(F.struct(*frame.columns).alias(RING)))


def write_ring(spark: SparkSession, spec: EntitySpec, provider: KeyProvider, tenant: str, key_id: bytes | None = None) -> DataFrame:
    """The keys of one version (the current one): header, aad, and key and index pads of each field."""
    key_id = provider.current_key_id(tenant) if key_id is None else key_id
    binary = T.BinaryType()
    values: dict = {"header": (binary, header_bytes(key_id)), "aad": (binary, associated_data(key_id)), "key_id": (binary, key_id)}
    for i, f in enumerate(spec.fields):
        values[f"key_{i}"] = (binary, provider.field_key(tenant, key_id, ENCRYPTION, spec.logical, f.logical))
        if f.searchable:
            inner, outer = hmac_pads(provider.field_key(tenant, key_id, BLIND_INDEX, spec.logical, f.logical))
            values[f"inner_{i}"], values[f"outer_{i}"] = (binary, inner), (binary, outer)
    return _one_row(spark, values)


def read_ring(spark: SparkSession, spec: EntitySpec, provider: KeyProvider, tenant: str, fields: list[FieldSpec]) -> DataFrame:
    """The keys of all versions the provider knows: a map by key id in hexadecimal for each field."""
    known = provider.known_key_ids(tenant)
    values = {
        f"keys_{spec.fields.index(f)}": (
            T.MapType(T.StringType(), T.BinaryType(), False),
            {k.hex().upper(): provider.field_key(tenant, k, ENCRYPTION, spec.logical, f.logical) for k in known},
        )
        for f in fields
    }
    return _one_row(spark, values or {"none": (T.IntegerType(), 0)})
