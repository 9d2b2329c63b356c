"""Blind indexes: HMAC-SHA256 of the normal form, as bytes on the driver and as a column."""

from __future__ import annotations

import hmac
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.normalize import Normalizer, normalize


class IndexPurpose(IntEnum):
    """What an index answers; equality only."""

    EXACT_MATCH = 1


def index_of(value: str, key: bytes, kind: Normalizer = Normalizer.DEFAULT, purpose: IndexPurpose = IndexPurpose.EXACT_MATCH) -> bytes:
    """The full 32 bytes for one value."""
    if purpose != IndexPurpose.EXACT_MATCH:
        raise NotImplementedError("only exact-match indexes exist")
    return hmac.digest(key, normalize(value, kind).encode(), "sha256")


def index_column(normal: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """The index of a column in normal form, from pad columns."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(normal, "UTF-8")), 256))
    return F.unhex(F.sha2(F.concat(outer_pad, inner), 256))
