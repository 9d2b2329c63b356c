"""Envelopes as columns: writing, parsing with error codes, detection.

Layout of version 1: magic, version, suite, associated-data scheme, key id
(after its length), nonce (after its length), tag (after its length),
ciphertext (after its length as four big-endian bytes). The associated data
are version, suite, scheme and key id.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.errors import ENVELOPE_MARK

#: Fixed values of the format.
MAGIC = b"PENC"
VERSION, SUITE, SCHEME = 1, 1, 1
NONCE_BYTES, TAG_BYTES = 12, 16
KEY_ID_MOST = 255
FIXED_OVERHEAD = 14


@dataclass(frozen=True)
class Suite:
    """A cipher that an envelope can name. Reserved ones have no sizes yet."""

    number: int
    name: str
    usable: bool = False
    nonce_bytes: int = 0
    tag_bytes: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.number < 256 or not self.name.strip():
            raise ValueError("a suite has a number from 1 to 255 and a name")
        if self.usable != (self.nonce_bytes > 0 and self.tag_bytes > 0) or min(self.nonce_bytes, self.tag_bytes) < 0:
            raise ValueError("a suite has sizes if and only if it can be used")


#: Suites by number, usable and reserved; others are unknown.
SUITES = {s.number: s for s in (Suite(0x01, "AES-256-GCM", True, NONCE_BYTES, TAG_BYTES), Suite(0x02, "AES-256-GCM-SIV"), Suite(0x03, "XChaCha20-Poly1305"), Suite(0x10, "AES-256-SIV"))}


def suite_of(number: int) -> Suite:
    """The suite of a number; SUITES.get gives None instead of raising."""
    found = SUITES.get(number)
    if found is None:
        raise ValueError(f"no suite has the number {number}")
    return found


#: Schemes of associated data by number: name, whether it can be used.
SCHEMES = {0x01: ("header-bound", True), 0x02: ("context-bound", False)}


class ParseCode(IntEnum):
    """Why bytes are no envelope; NONE if they are."""

    NONE = 0
    TOO_SHORT = 1
    INVALID_MAGIC = 2
    UNSUPPORTED_VERSION = 3
    UNKNOWN_SUITE = 4
    UNSUPPORTED_SUITE = 5
    UNKNOWN_SCHEME = 6
    UNSUPPORTED_SCHEME = 7
    INVALID_KEY_ID_LENGTH = 8
    KEY_ID_TRUNCATED = 9
    INVALID_NONCE_LENGTH = 10
    NONCE_TRUNCATED = 11
    INVALID_TAG_LENGTH = 12
    TAG_TRUNCATED = 13
    CIPHERTEXT_TOO_LONG = 14
    TRAILING_DATA = 15


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: encryption must not run twice for one envelope."""
    return F.transform(F.array(value), body)[0]


def header_bytes(key_id: bytes) -> bytes:
    """All that stands before the nonce's length."""
    if not 0 < len(key_id) <= KEY_ID_MOST:
        raise ValueError("a key id has 1 to 255 bytes")
    return MAGIC + bytes([VERSION, SUITE, SCHEME, len(key_id)]) + key_id


def associated_data(key_id: bytes) -> bytes:
    return bytes([VERSION, SUITE, SCHEME]) + key_id


def written(sealed: Column, header: Column) -> Column:
    """The envelope of aes_encrypt's nonce, ciphertext and tag; header as of header_bytes."""

    def build(x: Column) -> Column:
        size = F.octet_length(x) - (NONCE_BYTES + TAG_BYTES)
        return F.concat(
            header,
            F.lit(bytes([NONCE_BYTES])),
            F.substring(x, F.lit(1), F.lit(NONCE_BYTES)),
            F.lit(bytes([TAG_BYTES])),
            F.substring(x, size + NONCE_BYTES + 1, F.lit(TAG_BYTES)),
            F.unhex(F.lpad(F.hex(size.cast("long")), 8, "0")),
            F.substring(x, F.lit(NONCE_BYTES + 1), size),
        )

    return let(sealed, build)


def sealed_value(plain: Column, key: Column, header: Column, aad: Column, nonce: Column | None = None) -> Column:
    """The envelope of a binary column. A fixed nonce is for tests only; without one, each value gets a random one."""
    return written(F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"") if nonce is None else nonce, aad), header)


def _byte(b: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(b, at, F.lit(1))), 16, 10).cast("int")


def parse(b: Column) -> Column:
    """struct(code, version, suite, scheme, key_id, nonce, tag, ciphertext) of a binary column; null stays null.

    The first check that fails gives the code, in the order of the bytes. An
    envelope with an 18-byte key id, the usual one, is recognised by comparing
    its fixed bytes, and only its length field is computed.
    """
    size = F.octet_length(b)

    def at(offset: int | Column) -> Column:
        return F.lit(offset) if isinstance(offset, int) else offset

    key_len = _byte(b, F.lit(8))
    after_key = key_len + 9  # place of the nonce's length
    after_nonce = after_key + 1 + NONCE_BYTES
    after_tag = after_nonce + 1 + TAG_BYTES
    declared = F.conv(F.hex(F.substring(b, after_tag, F.lit(4))), 16, 10).cast("long")
    left = (size - after_tag - 3).cast("long")
    suite, scheme = _byte(b, F.lit(6)), _byte(b, F.lit(7))
    checks = [
        (size < 4, ParseCode.TOO_SHORT),
        (F.substring(b, 1, 4) != F.lit(MAGIC), ParseCode.INVALID_MAGIC),
        (size < 8, ParseCode.TOO_SHORT),
        (_byte(b, F.lit(5)) != VERSION, ParseCode.UNSUPPORTED_VERSION),
        (~suite.isin(*SUITES), ParseCode.UNKNOWN_SUITE),
        (~suite.isin(*[k for k, s in SUITES.items() if s.usable]), ParseCode.UNSUPPORTED_SUITE),
        (~scheme.isin(*SCHEMES), ParseCode.UNKNOWN_SCHEME),
        (~scheme.isin(*[k for k, (_, usable) in SCHEMES.items() if usable]), ParseCode.UNSUPPORTED_SCHEME),
        (key_len == 0, ParseCode.INVALID_KEY_ID_LENGTH),
        (size < after_key - 1, ParseCode.KEY_ID_TRUNCATED),
        (size < after_key, ParseCode.TOO_SHORT),
        (_byte(b, after_key) != NONCE_BYTES, ParseCode.INVALID_NONCE_LENGTH),
        (size < after_nonce - 1, ParseCode.NONCE_TRUNCATED),
        (size < after_nonce, ParseCode.TOO_SHORT),
        (_byte(b, after_nonce) != TAG_BYTES, ParseCode.INVALID_TAG_LENGTH),
        (size < after_tag - 1, ParseCode.TAG_TRUNCATED),
        (size < after_tag + 3, ParseCode.TOO_SHORT),
        (declared > left, ParseCode.CIPHERTEXT_TOO_LONG),
        (declared < left, ParseCode.TRAILING_DATA),
    ]
    slow = F.lit(int(ParseCode.NONE))
    for failed, code in reversed(checks):
        slow = F.when(failed, F.lit(int(code))).otherwise(slow)
    usual = MAGIC + bytes([VERSION, SUITE, SCHEME, 18])
    fast = (
        (size >= 60)
        & (F.substring(b, 1, 8) == F.lit(usual))
        & (F.substring(b, 27, 1) == F.lit(bytes([NONCE_BYTES])))
        & (F.substring(b, 40, 1) == F.lit(bytes([TAG_BYTES])))
        & (F.substring(b, 57, 4) == F.unhex(F.lpad(F.hex((size - 60).cast("long")), 8, "0")))
    )

    def fields(key_bytes: int | Column) -> list[Column]:
        start = 9 + key_bytes
        return [
            F.substring(b, F.lit(9), at(key_bytes)).alias("key_id"),
            F.substring(b, at(start + 1), F.lit(NONCE_BYTES)).alias("nonce"),
            F.substring(b, at(start + NONCE_BYTES + 2), F.lit(TAG_BYTES)).alias("tag"),
            F.substring(b, at(start + NONCE_BYTES + TAG_BYTES + 6), size).alias("ciphertext"),
        ]

    numbers = [F.lit(VERSION).alias("version"), F.lit(SUITE).alias("suite"), F.lit(SCHEME).alias("scheme")]
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("version", "int"), ("suite", "int"), ("scheme", "int"), ("key_id", "binary"), ("nonce", "binary"), ("tag", "binary"), ("ciphertext", "binary"))]
    parsed = let(
        slow,
        lambda code: F.when(code == 0, F.struct(code.alias("code"), *numbers, *fields(key_len))).otherwise(F.struct(code.alias("code"), *empty)),
    )
    return F.when(b.isNull(), F.lit(None)).when(fast, F.struct(F.lit(0).alias("code"), *numbers, *fields(18))).otherwise(parsed)


def from_text(value: Column) -> Column:
    """The bytes of a Base64 text, null if it is none."""
    return F.try_to_binary(value, F.lit("base64"))


def to_text(b: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(b), r"\s", "")


def is_envelope(value: Column, is_text: bool) -> Column:
    """Whether a stored or given value is structurally an envelope; never a guess from its beginning alone."""
    b = from_text(value) if is_text else value
    looks = value.startswith("UEVOQ") if is_text else F.substring(value, 1, 4) == F.lit(MAGIC)
    return F.when(value.isNull() | ~looks, F.lit(False)).otherwise(F.coalesce(let(b, lambda x: parse(x)["code"] == 0), F.lit(False)))


def checked(parsed: Column) -> Column:
    """parsed, raising where it is no envelope."""
    return F.when(parsed.isNull() | (parsed["code"] == 0), parsed).otherwise(
        F.raise_error(F.concat(F.lit(f"{ENVELOPE_MARK} "), parsed["code"].cast("string"), F.lit("] a stored value is no valid envelope")))
    )


def opened(parsed: Column, key: Column, aad: Column) -> Column:
    """The plaintext bytes; a wrong tag raises."""
    return F.aes_decrypt(F.concat(parsed["nonce"], parsed["ciphertext"], parsed["tag"]), key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def aad_of(parsed: Column) -> Column:
    return F.concat(F.lit(bytes([VERSION, SUITE, SCHEME])), parsed["key_id"])
