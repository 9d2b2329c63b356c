"""Key material on the driver: providers, tenant records, registries."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import IntEnum
from typing import Protocol

from veilframe.errors import KeyResolutionError
from veilframe.functions.kdf import KEY_BYTES, field_key, hkdf, prefixed
from veilframe.functions.normalize import trimmed

VERSION_BYTES = 2
NAME_MOST = 128


def tenant_name(value: str) -> str:
    """A tenant's name: without Unicode white space at its ends, not blank."""
    if not isinstance(value, str) or not (found := trimmed(value)):
        raise ValueError("a tenant must have a name")
    return found


def logical_name(value: str) -> str:
    """A logical name: trimmed, case-sensitive, at most 128 characters, no control characters."""
    if not isinstance(value, str) or not (found := trimmed(value)):
        raise ValueError("a logical name must not be blank")
    if len(found) > NAME_MOST:
        raise ValueError(f"a logical name has at most {NAME_MOST} characters")
    if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in found):
        raise ValueError("a logical name has no control characters")
    return found


class KeyProvider(Protocol):
    """Gives a tenant's key ids and working keys."""

    provider_id: str

    def current_key_id(self, tenant: str) -> bytes: ...

    def known_key_ids(self, tenant: str) -> list[bytes]: ...

    def field_key(self, tenant: str, key_id: bytes, purpose: str, entity: str, name: str) -> bytes: ...


class LocalKeyProvider:
    """Keys of every tenant from root keys by version. For development only: whoever has the roots has all keys.

    label tells the derivations of different deployments apart. To read data of
    an existing deployment, give its label.
    """

    provider_id = "local-development"

    def __init__(self, roots: bytes | Mapping[int, bytes], current: int | None = None, label: str = "veilframe.local-dev") -> None:
        versions = {1: roots} if isinstance(roots, bytes | bytearray) else dict(roots)
        if not versions:
            raise ValueError("at least one root key is needed")
        for version, root in versions.items():
            if not 1 <= version <= 0xFFFF:
                raise ValueError("versions are numbers from 1 to 65535")
            if len(root) < KEY_BYTES:
                raise ValueError(f"a root key has at least {KEY_BYTES} bytes")
        self._roots = {v: bytes(versions[v]) for v in sorted(versions)}
        self.current = max(self._roots) if current is None else current
        if self.current not in self._roots:
            raise ValueError(f"there is no root key of the current version {self.current}")
        self.label = label

    @classmethod
    def of(cls, versions: list[tuple[int, bytes]], current: int, **settings) -> LocalKeyProvider:
        """From pairs, of which no version may come twice."""
        if len({v for v, _ in versions}) != len(versions):
            raise ValueError("a version was given twice")
        return cls(dict(versions), current, **settings)

    def known_versions(self) -> list[int]:
        return list(self._roots)

    def key_id(self, tenant: str, version: int) -> bytes:
        prefix = hkdf(self._roots[version], prefixed(f"{self.label}.tmk-id.v1") + prefixed(tenant_name(tenant)), 16)
        return prefix + version.to_bytes(VERSION_BYTES, "big")

    def current_key_id(self, tenant: str) -> bytes:
        return self.key_id(tenant, self.current)

    def known_key_ids(self, tenant: str) -> list[bytes]:
        return [self.key_id(tenant, v) for v in self._roots]

    def field_key(self, tenant: str, key_id: bytes, purpose: str, entity: str, name: str) -> bytes:
        version = int.from_bytes(key_id[-VERSION_BYTES:], "big")
        if version not in self._roots or self.key_id(tenant, version) != key_id:
            raise KeyResolutionError("the key id is not one of this tenant's")
        master = hkdf(self._roots[version], prefixed(f"{self.label}.tmk.v1") + prefixed(tenant_name(tenant)))
        return field_key(master, purpose, entity, name)


class ServiceKind(IntEnum):
    """The service that wraps a master key."""

    LOCAL_DEVELOPMENT = 0
    AZURE_KEY_VAULT = 1
    AWS_KMS = 2
    GOOGLE_KMS = 3
    CUSTOM = 4


@dataclass(frozen=True)
class ServiceKey:
    """A key of a service, as that service names it."""

    kind: ServiceKind
    reference: str

    def __post_init__(self) -> None:
        if not self.reference or not self.reference.strip():
            raise ValueError("a service key must have a reference")
        object.__setattr__(self, "reference", self.reference.strip())


@dataclass(frozen=True)
class WrappedKey:
    """A master key as its service encrypted it."""

    key_id: bytes
    ciphertext: bytes = field(repr=False)

    def __post_init__(self) -> None:
        if not 0 < len(self.key_id) <= 255:
            raise ValueError("a key id has 1 to 255 bytes")
        if not self.ciphertext:
            raise ValueError("a wrapped key must not be empty")


class KeyService(Protocol):
    """Wraps and unwraps master keys."""

    provider_id: str

    def wrap(self, key_id: bytes, plain: bytes) -> WrappedKey: ...

    def unwrap(self, wrapped: WrappedKey) -> bytes: ...


@dataclass(frozen=True)
class MasterKeyVersion:
    """One version of a tenant's master key."""

    version: int
    service_key: ServiceKey
    wrapped: bytes | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not 1 <= self.version <= 0xFFFF:
            raise ValueError("versions are numbers from 1 to 65535")


@dataclass(frozen=True)
class TenantRecord:
    """A tenant's master key: a stable id, versions, the current one.

    Key ids are the id's bytes with the first three groups little-endian,
    then the version.
    """

    tenant: str
    master_id: uuid.UUID
    versions: tuple[MasterKeyVersion, ...]
    current: int

    def __post_init__(self) -> None:
        object.__setattr__(self, "tenant", tenant_name(self.tenant))
        ordered = tuple(sorted(self.versions, key=lambda v: v.version))
        numbers = [v.version for v in ordered]
        if not numbers or len(set(numbers)) != len(numbers):
            raise ValueError("a record has versions, each once")
        if self.current not in numbers:
            raise ValueError("the current version is not among the versions")
        if not self.master_id.int:
            raise ValueError("a record has a master key id")
        object.__setattr__(self, "versions", ordered)

    def key_id_for(self, version: int) -> bytes:
        return self.master_id.bytes_le + version.to_bytes(VERSION_BYTES, "big")

    @property
    def current_key_id(self) -> bytes:
        return self.key_id_for(self.current)

    def known_key_ids(self) -> list[bytes]:
        return [self.key_id_for(v.version) for v in self.versions]

    def version_of(self, key_id: bytes) -> MasterKeyVersion | None:
        return next((v for v in self.versions if self.key_id_for(v.version) == key_id), None)


class TenantRegistry:
    """Records in memory, one a tenant."""

    def __init__(self, records: list[TenantRecord] | tuple[TenantRecord, ...] = ()) -> None:
        self._records: dict[str, TenantRecord] = {}
        self._lock = threading.Lock()
        for r in records:
            self.put(r)

    def put(self, record: TenantRecord) -> None:
        with self._lock:
            self._records[record.tenant] = record

    def get(self, tenant: str) -> TenantRecord:
        found = self._records.get(tenant_name(tenant))
        if found is None:
            raise KeyResolutionError("the tenant has no key record")
        return found


class RegistryKeyProvider:
    """Keys of tenants whose records hold wrapped master keys.

    A tenant's version is unwrapped once and kept until ``forget``.
    """

    provider_id = "tenant-registry"

    def __init__(self, registry: TenantRegistry, services: Mapping[ServiceKind, KeyService]) -> None:
        self._registry, self._services = registry, services
        self._masters: dict[tuple[str, bytes], bytes] = {}

    def current_key_id(self, tenant: str) -> bytes:
        return self._registry.get(tenant).current_key_id

    def known_key_ids(self, tenant: str) -> list[bytes]:
        return self._registry.get(tenant).known_key_ids()

    def field_key(self, tenant: str, key_id: bytes, purpose: str, entity: str, name: str) -> bytes:
        record = self._registry.get(tenant)
        version, kept = record.version_of(key_id), (record.tenant, key_id)
        if version is None:
            raise KeyResolutionError("the key id is not one of this tenant's")
        if kept not in self._masters:
            if version.wrapped is None:
                raise KeyResolutionError(f"version {version.version} has no wrapped key")
            service = self._services.get(version.service_key.kind)
            if service is None:
                raise KeyResolutionError(f"no service is set for {version.service_key.kind.name}")
            self._masters[kept] = service.unwrap(WrappedKey(key_id, version.wrapped))
        return field_key(self._masters[kept], purpose, entity, name)

    def forget(self, tenant: str | None = None) -> None:
        """Drops the unwrapped keys of a tenant, or of all; the next use unwraps anew."""
        name = None if tenant is None else tenant_name(tenant)
        for kept in [k for k in self._masters if name in (None, k[0])]:
            del self._masters[kept]


def resolved_tenant(tenant: str | Callable[[], str | None]) -> str:
    """A tenant given by name or by a function that is asked at every operation; there is no default."""
    found = tenant() if callable(tenant) else tenant
    if found is None:
        raise ValueError("no tenant could be resolved")
    return tenant_name(found)
