"""The classification of every string and binary column, and strict mode."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veilframe.errors import StrictModeError
from veilframe.plans.spec import EntitySpec


class Classification(Enum):
    """What a column was declared to be."""

    ENCRYPTED = "encrypted"
    SEARCHABLE = "encrypted searchable"
    PLAINTEXT = "plaintext"
    UNCLASSIFIED = "UNCLASSIFIED"


@dataclass(frozen=True)
class AuditEntry:
    """One column."""

    entity: str
    logical: str | None
    column: str
    type: str
    classification: Classification

    @property
    def path(self) -> str:
        return f"{self.entity}.{self.column}"


@dataclass(frozen=True)
class AuditReport:
    """All string and binary columns of the entities; index columns aren't among them."""

    entries: tuple[AuditEntry, ...]

    @property
    def unclassified(self) -> tuple[AuditEntry, ...]:
        return tuple(e for e in self.entries if e.classification == Classification.UNCLASSIFIED)

    def __str__(self) -> str:
        pad = max([len(e.path) + 2 for e in self.entries], default=0)
        lines = [e.path.ljust(pad) + e.classification.value for e in self.entries]
        return "\n".join(lines or ["(no string or binary columns)"])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.entity, e.logical, e.column, e.type, e.classification.value) for e in self.entries]
        return spark.createDataFrame(rows, "entity string, logical string, column string, type string, classification string")


def _declared(spec: EntitySpec) -> dict[str, Classification]:
    """What the columns of an entity were declared to be; others are missing."""
    found = dict.fromkeys(spec.plain, Classification.PLAINTEXT)
    return found | {f.name: Classification.SEARCHABLE if f.searchable else Classification.ENCRYPTED for f in spec.fields}


def audit(specs: Iterable[EntitySpec]) -> AuditReport:
    """The report over entities, in their order and their columns' order."""
    entries = []
    for spec in specs:
        indexes, declared = set(spec.index_columns), _declared(spec)
        for c in spec.schema.fields:
            if isinstance(c.dataType, T.StringType | T.BinaryType) and c.name not in indexes:
                entries.append(AuditEntry(spec.name, spec.logical, c.name, c.dataType.simpleString(), declared.get(c.name, Classification.UNCLASSIFIED)))
    return AuditReport(tuple(entries))


def require_classified(specs: Iterable[EntitySpec]) -> None:
    """Raises with all unclassified columns of all entities, if there are any."""
    if found := audit(specs).unclassified:
        raise StrictModeError([e.path for e in found])
