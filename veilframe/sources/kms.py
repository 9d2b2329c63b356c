"""Key services: references as each names its keys, and adapters over small client protocols.

No vendor SDK is needed; a client is any object with encrypt and decrypt (and,
for Google, checksums). Errors of clients are wrapped; messages name the key
only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from enum import Enum
from typing import Protocol
from urllib.parse import urlsplit

from veilframe.errors import KeyProviderError, SpecError
from veilframe.functions.kdf import crc32c
from veilframe.sources.keys import KeyService, ServiceKey, ServiceKind, WrappedKey


def _given(text: str) -> str:
    if not isinstance(text, str) or not text.strip():
        raise ValueError("a key reference must not be blank")
    return text.strip()


class _FromServiceKey:
    kind: ServiceKind

    @classmethod
    def of(cls, key: ServiceKey):
        """The reference of a service key, which must be of this service."""
        if key.kind != cls.kind:
            raise ValueError(f"the service key is for {key.kind.name}, not for {cls.kind.name}")
        return cls.parse(key.reference)


class AwsReferenceKind(Enum):
    """The ways in which a key is named."""

    KEY_ARN = "key ARN"
    ALIAS_ARN = "alias ARN"
    KEY_ID = "key id"
    ALIAS_NAME = "alias name"


@dataclass(frozen=True)
class AwsKeyReference(_FromServiceKey):
    """A key ARN, alias ARN, key id or alias name; ARNs tell the region."""

    key: str
    form: AwsReferenceKind
    region: str | None = None
    kind = ServiceKind.AWS_KMS

    @classmethod
    def parse(cls, text: str) -> AwsKeyReference:
        value = _given(text)
        if value.startswith("arn:"):
            m = re.fullmatch(r"arn:[^:]*:kms:(?P<region>[^:]*):[^:]*:(?P<what>key|alias)/(?P<name>.*)", value, re.DOTALL)
            if not m or not m["region"].strip() or not m["name"]:
                raise ValueError("not the ARN of a key or alias with its region")
            return cls(value, AwsReferenceKind.KEY_ARN if m["what"] == "key" else AwsReferenceKind.ALIAS_ARN, m["region"])
        if value.startswith("alias/"):
            if value == "alias/":
                raise ValueError("an alias must have a name")
            return cls(value, AwsReferenceKind.ALIAS_NAME)
        if re.search(r"[ \t:/]", value):
            raise ValueError("not a key ARN, alias ARN, key id or alias name")
        return cls(value, AwsReferenceKind.KEY_ID)

    def __str__(self) -> str:
        return self.key


@dataclass(frozen=True)
class AzureKeyReference(_FromServiceKey):
    """https://host/keys/name, or with a version."""

    url: str
    vault: str
    name: str
    version: str | None = None
    kind = ServiceKind.AZURE_KEY_VAULT

    @classmethod
    def parse(cls, text: str) -> AzureKeyReference:
        value = _given(text)
        parts = urlsplit(value)
        if not parts.scheme or not parts.netloc:
            raise ValueError("not an absolute URL")
        if parts.scheme.lower() != "https":
            raise ValueError("a vault's key must be named by an https URL")
        path = [p for p in parts.path.split("/") if p]
        if len(path) not in (2, 3) or path[0].lower() != "keys":
            raise ValueError("expected https://<vault>/keys/<name>, or with /<version>")
        return cls(value, f"https://{parts.netloc}", path[1], path[2] if len(path) == 3 else None)

    @property
    def has_version(self) -> bool:
        return self.version is not None

    def __str__(self) -> str:
        return self.url


@dataclass(frozen=True)
class GoogleKeyReference(_FromServiceKey):
    """projects/p/locations/l/keyRings/r/cryptoKeys/k, without a version."""

    name: str
    project: str
    location: str
    ring: str
    key: str
    kind = ServiceKind.GOOGLE_KMS

    @classmethod
    def parse(cls, text: str) -> GoogleKeyReference:
        value = _given(text)
        one = "([A-Za-z0-9_-]+)"
        m = re.fullmatch(f"projects/{one}/locations/{one}/keyRings/{one}/cryptoKeys/{one}(/cryptoKeyVersions/[^/]*)?", value)
        if not m:
            raise ValueError("expected projects/<p>/locations/<l>/keyRings/<r>/cryptoKeys/<k>")
        if m[5] is not None:
            raise ValueError("a key is named without its version; the service chooses that")
        return cls(value, *m.groups()[:4])

    def __str__(self) -> str:
        return self.name


class SymmetricClient(Protocol):
    """encrypt and decrypt under a named key."""

    def encrypt(self, key: str, plain: bytes) -> bytes: ...

    def decrypt(self, key: str, wrapped: bytes) -> bytes: ...


class _Service:
    provider_id = "key-service"
    title = "key service"

    def __init__(self, reference, client) -> None:
        if reference is None or client is None:
            raise ValueError("a reference and a client are needed")
        self.reference, self.client = reference, client

    def _encrypt(self, plain: bytes) -> bytes:
        return self.client.encrypt(str(self.reference), plain)

    def _decrypt(self, wrapped: bytes) -> bytes:
        return self.client.decrypt(str(self.reference), wrapped)

    def wrap(self, key_id: bytes, plain: bytes) -> WrappedKey:
        if not plain:
            raise ValueError("key material must not be empty")
        try:
            return WrappedKey(key_id, self._encrypt(plain))
        except KeyProviderError:
            raise
        except Exception as e:
            raise KeyProviderError(f"{self.title} could not wrap with key '{self.reference}'") from e

    def unwrap(self, wrapped: WrappedKey) -> bytes:
        try:
            return self._decrypt(wrapped.ciphertext)
        except KeyProviderError:
            raise
        except Exception as e:
            raise KeyProviderError(f"{self.title} could not unwrap with key '{self.reference}'") from e


class AwsKms(_Service):
    """Symmetric encryption; the key is named on both ways."""

    provider_id, title = "aws-kms", "AWS KMS"


class AzureKeyVault(_Service):
    """RSA-OAEP-256 wrapping; the client takes the algorithm's name."""

    provider_id, title = "azure-key-vault", "Azure Key Vault"
    algorithm = "RSA-OAEP-256"

    def _encrypt(self, plain: bytes) -> bytes:
        return self.client.wrap_key(self.algorithm, plain)

    def _decrypt(self, wrapped: bytes) -> bytes:
        return self.client.unwrap_key(self.algorithm, wrapped)


@dataclass(frozen=True)
class ChecksummedResult:
    """An answer with its CRC-32C; verified tells that the service checked the request's."""

    data: bytes
    checksum: int
    verified: bool = True


class GoogleKms(_Service):
    """Symmetric encryption with CRC-32C both ways; any mismatch fails.

    The client's encrypt and decrypt take (key, data, checksum) and give a
    ChecksummedResult.
    """

    provider_id, title = "google-cloud-kms", "Google Cloud KMS"

    def _encrypt(self, plain: bytes) -> bytes:
        got = self.client.encrypt(str(self.reference), plain, crc32c(plain))
        if not got.verified:
            raise KeyProviderError(f"{self.title} did not verify the checksum of a request for key '{self.reference}'")
        return self._intact(got)

    def _decrypt(self, wrapped: bytes) -> bytes:
        return self._intact(self.client.decrypt(str(self.reference), wrapped, crc32c(wrapped)))

    def _intact(self, got: ChecksummedResult) -> bytes:
        if got.checksum != crc32c(got.data):
            raise KeyProviderError(f"{self.title} sent data with another checksum for key '{self.reference}'")
        return got.data


class KeyServices(Mapping):
    """The services of an application, by kind, for a RegistryKeyProvider.

    A key's reference is checked when it is registered. The client is made by
    its factory when the service is first used. The first registration of a
    kind counts.
    """

    def __init__(self) -> None:
        self._makers: dict[ServiceKind, Callable[[], KeyService]] = {}
        self._made: dict[ServiceKind, KeyService] = {}

    def _put(self, kind: ServiceKind, reference: str | None, of: type, service: type, client: Callable) -> KeyServices:
        if client is None or not callable(client):
            raise TypeError("a factory of the client is needed")
        if reference is None or not reference.strip():
            raise SpecError(f"{service.title} needs the reference of a key")
        known = of.parse(reference)
        self._makers.setdefault(kind, lambda: service(known, client()))
        return self

    def aws(self, reference: str | None, client: Callable) -> KeyServices:
        return self._put(ServiceKind.AWS_KMS, reference, AwsKeyReference, AwsKms, client)

    def azure(self, reference: str | None, client: Callable) -> KeyServices:
        return self._put(ServiceKind.AZURE_KEY_VAULT, reference, AzureKeyReference, AzureKeyVault, client)

    def google(self, reference: str | None, client: Callable) -> KeyServices:
        return self._put(ServiceKind.GOOGLE_KMS, reference, GoogleKeyReference, GoogleKms, client)

    def custom(self, service: KeyService) -> KeyServices:
        self._makers.setdefault(ServiceKind.CUSTOM, lambda: service)
        return self

    def __getitem__(self, kind: ServiceKind) -> KeyService:
        if kind not in self._made:
            self._made[kind] = self._makers[kind]()
        return self._made[kind]

    def __iter__(self) -> Iterator[ServiceKind]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)
