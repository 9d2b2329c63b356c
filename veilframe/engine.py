"""One object that ties catalogue, keys, tenant and strict mode to a session."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from veilframe.errors import ConfiguredTwiceError, FieldEncryptionError
from veilframe.operators import codec, migrate, search, write
from veilframe.plans.audit import AuditReport, audit
from veilframe.plans.spec import Catalogue
from veilframe.sources.keys import KeyProvider, LocalKeyProvider, resolved_tenant


class Options:
    """What an engine is made of; each option once."""

    def __init__(self) -> None:
        self.provider: KeyProvider | None = None
        self.tenant: str | Callable[[], str | None] | None = None
        self.strict = False

    def use_local_keys(self, roots, current: int | None = None, **settings) -> Options:
        return self.use_keys(LocalKeyProvider(roots, current, **settings))

    def use_keys(self, provider: KeyProvider) -> Options:
        if self.provider is not None:
            raise ConfiguredTwiceError("a key provider is set already")
        if provider is None:
            raise ValueError("the key provider must not be null")
        self.provider = provider
        return self

    def use_tenant(self, tenant: str | Callable[[], str | None]) -> Options:
        """One tenant by name, or a function that is asked at every operation."""
        if self.tenant is not None:
            raise ConfiguredTwiceError("a tenant is set already")
        if not callable(tenant):
            resolved_tenant(tenant)
        self.tenant = tenant
        return self

    def strict_mode(self) -> Options:
        self.strict = True
        return self


class Engine:
    """The operators over a finished catalogue. Entities are given by name."""

    def __init__(self, spark: SparkSession, catalogue: Catalogue, options: Options) -> None:
        if options.provider is None or options.tenant is None:
            raise FieldEncryptionError("a key provider and a tenant are needed")
        list(catalogue)  # raises if it isn't finished
        self.spark, self.catalogue, self.options = spark, catalogue, options

    def _tenant(self) -> str:
        return resolved_tenant(self.options.tenant)

    def encrypt(self, df: DataFrame, entity: str, **settings) -> DataFrame:
        return codec.encrypt(df, self.catalogue[entity], self.options.provider, self._tenant(), **settings)

    def decrypt(self, df: DataFrame, entity: str, **settings) -> DataFrame:
        return codec.decrypt(df, self.catalogue[entity], self.options.provider, self._tenant(), **settings)

    def where_equals(self, stored: DataFrame, entity: str, field: str, term: str) -> DataFrame:
        return search.where_equals(stored, self.catalogue[entity], field, term, self.options.provider, self._tenant())

    def where_in(self, stored: DataFrame, entity: str, field: str, terms: Iterable[str], **settings) -> DataFrame:
        return search.where_in(stored, self.catalogue[entity], field, terms, self.options.provider, self._tenant(), **settings)

    def where_email(self, stored: DataFrame, entity: str, field: str, term: str) -> DataFrame:
        return search.where_email(stored, self.catalogue[entity], field, term, self.options.provider, self._tenant())

    def save(self, df: DataFrame, entity: str, path: str, **settings) -> None:
        strict = self.catalogue if self.options.strict else None
        write.save(df, self.catalogue[entity], self.options.provider, self._tenant(), path, strict_over=strict, **settings)

    def upsert(self, stored: DataFrame, changes: DataFrame, entity: str, key: str) -> DataFrame:
        return write.upsert(stored, changes, self.catalogue[entity], self.options.provider, self._tenant(), key)

    def migration_plan(self, stored: DataFrame, entity: str) -> DataFrame:
        return migrate.migration_plan(stored, self.catalogue[entity], self.options.provider, self._tenant())

    def reencrypt(self, stored: DataFrame, entity: str) -> DataFrame:
        return migrate.reencrypt(stored, self.catalogue[entity], self.options.provider, self._tenant())

    @cached_property
    def _report(self) -> AuditReport:
        return audit(self.catalogue)

    def audit(self) -> AuditReport:
        """The report over the catalogue, which is finished and can't change."""
        return self._report
