"""Normalizers of searchable values, on the driver for terms and as columns for stored values. Both must agree.

Unicode white space is trimmed, the email normalizer lowers case, and the
result is composed (NFC). The column form trims and lowers in the JVM. Spark has
no function that composes, so every row passes through a Python worker, which
gets null in the place of ASCII values.
"""

from __future__ import annotations

import re
import unicodedata
from enum import IntEnum

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that trimming removes, as a class both engines know.
TRIMMED = r"[\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


class Normalizer(IntEnum):
    """How a value is made comparable."""

    DEFAULT = 0
    EMAIL = 1


def _lower(text: str) -> str:
    """Lower case, one character for one, as an invariant culture does."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def trimmed(value: str) -> str:
    """value without Unicode white space at its ends (which, unlike in str.strip, leaves U+001C to U+001F)."""
    return re.sub(rf"\A{TRIMMED}|{TRIMMED}\Z", "", value)


def normalize(value: str, kind: Normalizer) -> str:
    """The normal form of a search term."""
    inner = trimmed(value)
    return unicodedata.normalize("NFC", _lower(inner) if kind == Normalizer.EMAIL else inner)


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _lowered_composed(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        if v is None:
            return None
        return unicodedata.normalize("NFC", "".join(c.lower() if len(c.lower()) == 1 else c for c in v))

    return values.map(one)


def normalized(value: Column, kind: Normalizer) -> Column:
    """The normal form of a column."""
    inner = F.regexp_replace(value, rf"\A{TRIMMED}|{TRIMMED}\z", "")
    ascii_only = inner.rlike(r"\A\p{ASCII}*\z")
    other = F.when(~ascii_only, inner)
    if kind == Normalizer.EMAIL:
        return F.when(ascii_only, F.lower(inner)).otherwise(_lowered_composed(other))
    return F.when(ascii_only, inner).otherwise(_composed(other))
