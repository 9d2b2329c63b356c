"""Key derivation on the driver: HKDF-SHA256, field subkeys, HMAC pads, CRC-32C."""

from __future__ import annotations

import hashlib
import hmac

KEY_BYTES = 32
ENCRYPTION, BLIND_INDEX = "enc", "idx"


def hkdf(key: bytes, info: bytes, length: int = KEY_BYTES, salt: bytes = b"") -> bytes:
    """RFC 5869 with SHA-256."""
    if not 0 < length <= 255 * 32:
        raise ValueError("length must be from 1 to 8160")
    pseudo = hmac.digest(salt or bytes(32), key, "sha256")
    out = block = b""
    counter = 1
    while len(out) < length:
        block = hmac.digest(pseudo, block + info + bytes([counter]), "sha256")
        out, counter = out + block, counter + 1
    return out[:length]


def prefixed(text: str) -> bytes:
    """The text's UTF-8 bytes after their number, as two big-endian bytes."""
    raw = text.encode()
    if len(raw) > 0xFFFF:
        raise ValueError("a part of the derivation info is too long")
    return len(raw).to_bytes(2, "big") + raw


def field_key(master: bytes, purpose: str, entity: str, field: str) -> bytes:
    """The working key of one field and purpose."""
    return hkdf(master, prefixed(purpose) + prefixed(entity) + prefixed(field))


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer padded key blocks of HMAC-SHA256."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)  # the reversed Castagnoli polynomial
        table.append(n)
    return table


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli)."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF
