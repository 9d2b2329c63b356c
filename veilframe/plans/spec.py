"""Entities and their fields: declared by annotations or a builder, merged and checked once, then fixed."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Annotated, get_args, get_origin, get_type_hints

from pyspark.sql import types as T

from veilframe.errors import ConfiguredTwiceError, NotRegisteredError, SpecError
from veilframe.functions.normalize import Normalizer
from veilframe.sources.keys import logical_name

INDEX_SUFFIX = "Index"
#: The field's metadata key in Spark schemas.
METADATA = "veilframe"


class Treatment(Enum):
    """What happens to a column."""

    ENCRYPTED = "encrypted"
    SEARCHABLE = "encrypted searchable"
    PLAINTEXT = "plaintext"


@dataclass(frozen=True)
class Mark:
    """A declared treatment of one column, from either style; equal marks may come from both."""

    treatment: Treatment
    logical: str = ""
    normalizer: int | None = None
    index: str | None = None


def encrypted(logical: str) -> Mark:
    return Mark(Treatment.ENCRYPTED, logical)


def searchable(logical: str, normalizer: int = Normalizer.DEFAULT, index: str | None = None) -> Mark:
    return Mark(Treatment.SEARCHABLE, logical, normalizer, index)


def email(logical: str, index: str | None = None) -> Mark:
    return searchable(logical, Normalizer.EMAIL, index)


def plaintext() -> Mark:
    return Mark(Treatment.PLAINTEXT)


@dataclass(frozen=True)
class FieldSpec:
    """A checked encrypted column."""

    name: str
    is_text: bool
    logical: str
    searchable: bool = False
    normalizer: Normalizer | None = None
    index: str | None = None
    index_is_declared: bool = False


@dataclass(frozen=True)
class EntitySpec:
    """A checked entity: logical name, encrypted columns in order, plaintext columns, schema of its plain form."""

    name: str
    logical: str | None
    schema: T.StructType
    fields: tuple[FieldSpec, ...] = ()
    plain: frozenset[str] = frozenset()

    def field(self, name: str) -> FieldSpec:
        if not isinstance(name, str):
            raise SpecError("a field is given by its name, not by an expression")
        found = next((f for f in self.fields if f.name == name), None)
        if found is None:
            raise SpecError(f"{self.name}.{name} is not an encrypted field")
        return found

    def searchable(self, name: str) -> FieldSpec:
        found = self.field(name)
        if not found.searchable:
            raise SpecError(f"{self.name}.{name} is encrypted but not searchable")
        return found

    @property
    def index_columns(self) -> list[str]:
        return [f.index for f in self.fields if f.searchable]

    def stored_schema(self) -> T.StructType:
        """The schema of the stored form, with the treatment in the columns' metadata."""
        by_name = {f.name: f for f in self.fields}
        out = []
        for c in self.schema.fields:
            spec = by_name.get(c.name)
            mark = {METADATA: {"entity": self.name, "treatment": (Treatment.SEARCHABLE if spec.searchable else Treatment.ENCRYPTED).value}} if spec else {}
            out.append(T.StructField(c.name, c.dataType, c.nullable, {**c.metadata, **mark}))
        have = set(self.schema.names)
        return T.StructType(out + [T.StructField(i, T.BinaryType(), True) for i in self.index_columns if i not in have])


class FieldBuilder:
    """The marks of one column, each column at most once."""

    def __init__(self, owner: EntityBuilder, name: str) -> None:
        self._owner, self._name = owner, name

    def _set(self, mark: Mark) -> EntityBuilder:
        if self._name in self._owner.marks:
            other = self._owner.marks[self._name]
            if Treatment.PLAINTEXT in (mark.treatment, other.treatment) and mark.treatment != other.treatment:
                raise SpecError(f"{self._owner.name}.{self._name} is both encrypted and plaintext")
            raise ConfiguredTwiceError(f"{self._owner.name}.{self._name} is configured twice")
        self._owner.marks[self._name] = mark
        return self._owner

    def encrypted(self, logical: str) -> EntityBuilder:
        return self._set(encrypted(logical))

    def searchable(self, logical: str, normalizer: int = Normalizer.DEFAULT, index: str | None = None) -> EntityBuilder:
        return self._set(searchable(logical, normalizer, index))

    def email(self, logical: str, index: str | None = None) -> EntityBuilder:
        return self._set(email(logical, index))

    def plaintext(self) -> EntityBuilder:
        return self._set(plaintext())


@dataclass
class EntityBuilder:
    """An entity being declared."""

    name: str
    schema: T.StructType
    logical: str | None = None
    marks: dict[str, Mark] = field(default_factory=dict)
    annotated: dict[str, list[Mark]] = field(default_factory=dict)

    def encrypted_entity(self, logical: str) -> EntityBuilder:
        if self.logical is not None and self.logical != logical:
            raise SpecError(f"{self.name} has two logical names")
        self.logical = logical
        return self

    def field(self, name: str) -> FieldBuilder:
        return FieldBuilder(self, name)


_TYPES = {str: T.StringType(), bytes: T.BinaryType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}


def annotated_entity(cls: type, schema: T.StructType | None = None) -> EntityBuilder:
    """An entity from a class: its annotations Annotated[type, mark] and its attribute entity_logical_name. Inherited ones count."""
    columns, marks = [], {}
    for name, hint in get_type_hints(cls, include_extras=True).items():
        base = get_args(hint)[0] if get_origin(hint) is Annotated else hint
        plain = next((a for a in get_args(base) if a is not type(None)), base) if get_args(base) else base
        columns.append(T.StructField(name, _TYPES.get(plain, T.StringType()) if isinstance(plain, type) else plain, True))
        found = [m for m in get_args(hint)[1:] if isinstance(m, Mark)] if get_origin(hint) is Annotated else []
        if found:
            marks[name] = found
    return EntityBuilder(cls.__name__, schema or T.StructType(columns), getattr(cls, "entity_logical_name", None), annotated=marks)


def _field(entity: EntityBuilder, name: str, mark: Mark) -> FieldSpec:
    """One checked field."""
    where = f"{entity.name}.{name}"
    kinds = {c.name: c.dataType for c in entity.schema.fields}
    if name not in kinds:
        raise SpecError(f"{where} is not a column")
    is_text = isinstance(kinds[name], T.StringType)
    if not is_text and not isinstance(kinds[name], T.BinaryType):
        raise SpecError(f"{where} must be a string or binary column")
    try:
        logical = logical_name(mark.logical)
    except ValueError as e:
        raise SpecError(f"{where}: {e}") from e
    base = FieldSpec(name, is_text, logical)
    if mark.treatment != Treatment.SEARCHABLE:
        return base
    if not is_text:
        raise SpecError(f"{where} is searchable but not a string column")
    if mark.normalizer is None or mark.normalizer not in list(Normalizer):
        raise SpecError(f"{where} has no known normalizer")
    index = mark.index or name + INDEX_SUFFIX
    if index == name:
        raise SpecError(f"{where} can't be its own index")
    if mark.index and index not in kinds:
        raise SpecError(f"{where}: the index column {index} does not exist")
    if index in kinds and not isinstance(kinds[index], T.BinaryType):
        raise SpecError(f"{where}: the column {index} is not binary")
    return replace(base, searchable=True, normalizer=Normalizer(mark.normalizer), index=index, index_is_declared=index in kinds)


def checked(entity: EntityBuilder) -> EntitySpec:
    """The finished entity: both styles merged, conflicts refused, every rule checked."""
    merged: dict[str, Mark] = {}
    for name, found in entity.annotated.items():
        if len(found) > 1:
            kinds = {m.treatment for m in found}
            raise SpecError(f"{entity.name}.{name} is both encrypted and plaintext" if Treatment.PLAINTEXT in kinds and len(kinds) > 1 else f"{entity.name}.{name} has more than one mark")
        merged[name] = found[0]
    for name, mark in entity.marks.items():
        if name in merged and merged[name] != mark:
            raise SpecError(f"{entity.name}.{name} is declared in two different ways")
        merged[name] = mark
    secret = {n: m for n, m in merged.items() if m.treatment != Treatment.PLAINTEXT}
    logical = None
    if entity.logical is not None or secret:
        try:
            logical = logical_name(entity.logical or "")
        except ValueError as e:
            raise SpecError(f"{entity.name} has encrypted fields and needs a logical name: {e}") from e
    ordered = [c for c in entity.schema.names if c in secret] + [n for n in secret if n not in entity.schema.names]
    fields = tuple(_field(entity, n, secret[n]) for n in ordered)
    for c in (n for n, m in merged.items() if m.treatment == Treatment.PLAINTEXT):
        if c not in entity.schema.names:
            raise SpecError(f"{entity.name}.{c} is not a column")
    indexes = [f.index for f in fields if f.searchable]
    if len(set(indexes)) != len(indexes) or set(indexes) & {f.name for f in fields}:
        raise SpecError(f"{entity.name}: index columns must be distinct and not encrypted themselves")
    return EntitySpec(entity.name, logical, entity.schema, fields, frozenset(merged) - frozenset(secret))


_BY_NAME = {
    "string": T.StringType(), "binary": T.BinaryType(), "int": T.IntegerType(), "long": T.LongType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(),
}


def simple_schema(text: str) -> T.StructType:
    """A schema of plain types, as "name type, ..."; unlike Spark's parser this needs no session."""
    columns = [c.split() for c in text.split(",")]
    for c in columns:
        if len(c) != 2 or c[1] not in _BY_NAME:
            raise SpecError(f"give a StructType for '{' '.join(c)}'")
    return T.StructType([T.StructField(name, _BY_NAME[kind]) for name, kind in columns])


class Catalogue:
    """Entities, fixed by finish()."""

    def __init__(self) -> None:
        self._open: dict[str, EntityBuilder] = {}
        self._done: dict[str, EntitySpec] | None = None

    def entity(self, name: str, schema: T.StructType | str) -> EntityBuilder:
        """Declares an entity by name and the schema of its plain form."""
        made = EntityBuilder(name, schema if isinstance(schema, T.StructType) else simple_schema(schema))
        return self._add(made)

    def annotated(self, cls: type, schema: T.StructType | None = None) -> EntityBuilder:
        return self._add(annotated_entity(cls, schema))

    def _add(self, made: EntityBuilder) -> EntityBuilder:
        if self._done is not None:
            raise ConfiguredTwiceError("the catalogue is finished")
        if made.name in self._open:
            raise ConfiguredTwiceError(f"{made.name} is declared twice")
        self._open[made.name] = made
        return made

    def finish(self) -> Catalogue:
        self._done = {n: checked(e) for n, e in self._open.items()}
        return self

    def __iter__(self):
        return iter(self._specs().values())

    def _specs(self) -> dict[str, EntitySpec]:
        if self._done is None:
            raise NotRegisteredError("the catalogue is not finished")
        return self._done

    def __getitem__(self, name: str) -> EntitySpec:
        found = self._specs().get(name)
        if found is None:
            raise NotRegisteredError(f"no entity {name} is registered")
        return found
