"""What goes wrong, by kind."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager


class FieldEncryptionError(Exception):
    """Root of this library's errors. Messages never hold keys or plaintext."""


class SpecError(FieldEncryptionError, ValueError):
    """An invalid or conflicting specification."""


class ConfiguredTwiceError(FieldEncryptionError, RuntimeError):
    """A field, an option or an engine was configured more than once."""


class NotRegisteredError(FieldEncryptionError, RuntimeError):
    """An entity is used that no finished catalogue knows."""


class KeyResolutionError(FieldEncryptionError):
    """No key for a key id, or no way to unwrap one."""


class EnvelopeError(FieldEncryptionError):
    """A stored value is no valid envelope; code tells why."""

    def __init__(self, message: str, code: int | None = None) -> None:
        super().__init__(message)
        self.code = code


class DecryptionError(FieldEncryptionError):
    """Authentication failed: wrong key or scope, or changed bytes."""


class AlreadyEncryptedError(FieldEncryptionError):
    """A value to encrypt is an envelope already."""


class StrictModeError(FieldEncryptionError):
    """Columns without a classification, all of them."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__("unclassified columns: " + ", ".join(paths))
        self.paths = paths


class KeyProviderError(FieldEncryptionError):
    """A key service failed. The message names the key, never its material."""


#: Marks in messages that executors raise, and what they become.
ENVELOPE_MARK, KEY_MARK, TWICE_MARK, BASE64_MARK = "[INVALID_ENVELOPE", "[KEY_NOT_RESOLVED]", "[ALREADY_ENCRYPTED]", "[INVALID_BASE64]"


@contextmanager
def spark_errors() -> Iterator[None]:
    """Turns errors that executors raise inside into this library's."""
    try:
        yield
    except FieldEncryptionError:
        raise
    except Exception as e:
        text = str(e)
        if m := re.search(r"\[INVALID_ENVELOPE (\d+)\][^\n]*", text):
            raise EnvelopeError(m[0], int(m[1])) from e
        if m := re.search(re.escape(BASE64_MARK) + r"[^\n]*", text):
            raise EnvelopeError(m[0]) from e
        if m := re.search(re.escape(KEY_MARK) + r"[^\n]*", text):
            raise KeyResolutionError(m[0]) from e
        if m := re.search(re.escape(TWICE_MARK) + r"[^\n]*", text):
            raise AlreadyEncryptedError(m[0]) from e
        if "AES_CRYPTO_ERROR" in text or "AEADBadTag" in text:
            raise DecryptionError("a value failed authentication: wrong key or scope, or changed bytes") from e
        raise
