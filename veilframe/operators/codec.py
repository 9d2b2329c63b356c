"""Encrypting the columns of an entity and decrypting them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.errors import BASE64_MARK, KEY_MARK, TWICE_MARK, SpecError
from veilframe.functions.blind_index import index_column
from veilframe.functions.envelope import aad_of, checked, from_text, is_envelope, let, opened, parse, sealed_value, to_text
from veilframe.functions.normalize import normalized
from veilframe.operators.ring import RING, read_ring, write_ring
from veilframe.plans.spec import EntitySpec, FieldSpec
from veilframe.sources.keys import KeyProvider


def _require_columns(df: DataFrame, spec: EntitySpec) -> None:
    for f in spec.fields:
        if f.name not in df.columns:
            raise SpecError(f"{spec.name}: the DataFrame has no column {f.name}")
        kind = df.schema[f.name].dataType
        if not isinstance(kind, T.StringType if f.is_text else T.BinaryType):
            raise SpecError(f"{spec.name}.{f.name} must be {'string' if f.is_text else 'binary'}, not {kind.simpleString()}")


def _guarded(value: Column, f: FieldSpec, entity: str) -> Column:
    """value, raising if it is an envelope already. It is part of the expression, so it can't be pruned away."""
    message = F.raise_error(F.lit(f"{TWICE_MARK} {entity}.{f.name} holds an envelope already"))
    return F.when(is_envelope(value, f.is_text), message).otherwise(value)


def _bytes(value: Column, is_text: bool) -> Column:
    return F.encode(value, "UTF-8") if is_text else value


def envelope_column(value: Column, f: FieldSpec, at: int, nonce: Column | None = None) -> Column:
    """The stored form of a column, from the ring's row."""
    ring = F.col(RING)
    sealed = sealed_value(_bytes(value, f.is_text), ring[f"key_{at}"], ring["header"], ring["aad"], nonce)
    return F.when(value.isNotNull(), to_text(sealed) if f.is_text else sealed)


def index_of_column(value: Column, f: FieldSpec, at: int) -> Column:
    ring = F.col(RING)
    return F.when(value.isNotNull(), index_column(normalized(value, f.normalizer), ring[f"inner_{at}"], ring[f"outer_{at}"]))


def _shaped(df: DataFrame, made: dict[str, Column], spec: EntitySpec) -> DataFrame:
    """df's columns in order, those in made replaced, index columns that it lacks added; treatments in the metadata."""
    marks = {c.name: c.metadata for c in spec.stored_schema().fields}

    def one(name: str) -> Column:
        return made[name].alias(name, metadata=marks.get(name) or {}) if name in made else F.col(f"`{name}`")

    new = [i for i in spec.index_columns if i not in df.columns and i in made]
    return df.select(*[one(c) for c in df.columns if c != RING], *[one(c) for c in new])


def encrypt(df: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, *, key_id: bytes | None = None, fixed_nonce: bytes | None = None) -> DataFrame:
    """df with the entity's columns in stored form and its index columns.

    Text columns become Base64 envelopes, binary ones envelopes. Null stays
    null, with a null index. Evaluating the result twice gives two sets of
    nonces: write it before using it twice. fixed_nonce is for tests.
    """
    _require_columns(df, spec)
    if not spec.fields:
        return df
    joined = df.crossJoin(write_ring(df.sparkSession, spec, provider, tenant, key_id))
    nonce = None if fixed_nonce is None else F.lit(fixed_nonce)
    made: dict[str, Column] = {}
    for i, f in enumerate(spec.fields):
        value = F.col(f"`{f.name}`")
        made[f.name] = envelope_column(_guarded(value, f, spec.name), f, i, nonce)
        if f.searchable:
            made[f.index] = index_of_column(value, f, i)
    return _shaped(joined, made, spec)


def envelope_bytes(value: Column, f: FieldSpec) -> Column:
    """The envelope of a stored value; text that is no Base64 raises."""
    if not f.is_text:
        return value
    raw = from_text(value)
    return F.when(value.isNull(), F.lit(None)).otherwise(F.coalesce(raw, F.raise_error(F.lit(f"{BASE64_MARK} {f.name} holds text that is no Base64")).cast("binary")))


def plain_bytes(value: Column, f: FieldSpec, at: int) -> Column:
    """The plaintext of a stored column, as bytes, from the read ring's row: structure, key, then authentication."""
    keys = F.col(RING)[f"keys_{at}"]

    def open_(p: Column) -> Column:
        key = F.coalesce(F.try_element_at(keys, F.hex(p["key_id"])), F.raise_error(F.lit(f"{KEY_MARK} {f.name} is under a key that this tenant's provider doesn't know")).cast("binary"))
        return F.when(p.isNotNull(), opened(p, key, aad_of(p)))

    return F.when(value.isNull(), F.lit(None)).otherwise(let(checked(let(envelope_bytes(value, f), parse)), open_))


def decrypt(df: DataFrame, spec: EntitySpec, provider: KeyProvider, tenant: str, fields: list[str] | None = None, validate: bool = False) -> DataFrame:
    """df with the entity's stored columns (or those of fields) in plain form; index columns stay.

    Spark is lazy: a value that can't be decrypted raises when its column is
    computed. validate decrypts everything once now.
    """
    _require_columns(df, spec)
    wanted = [spec.field(n) for n in fields] if fields is not None else list(spec.fields)
    if not wanted:
        return df
    joined = df.crossJoin(read_ring(df.sparkSession, spec, provider, tenant, wanted))
    made = {}
    for f in wanted:
        plain = plain_bytes(F.col(f"`{f.name}`"), f, spec.fields.index(f))
        made[f.name] = F.decode(plain, "UTF-8") if f.is_text else plain
    out = joined.select(*[made[c].alias(c, metadata={}) if c in made else F.col(f"`{c}`") for c in df.columns])
    if validate:
        out.agg(*[F.sum(F.octet_length(F.col(f"`{f.name}`"))) for f in wanted]).collect()
    return out
