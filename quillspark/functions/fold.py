"""Folding of text into canonical keys, the same for stored keys and for queries.

Compatibility decomposition; marks dropped; lower case (final sigma included); letters and
numbers kept; runs of white space and ``- . , ( ) /`` one space between kept characters;
everything else dropped without breaking a run.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEPARATORS = frozenset("-.,()/")
#: Letters by property that Python counts as symbols.
_ENCLOSED = (range(0x1F150, 0x1F16A), range(0x1F170, 0x1F18A))
#: White space to Python, but not by the Unicode property.
_NOT_SPACE = range(0x1C, 0x20)


class _Marks(dict):
    """translate() table that drops marks; filled as characters are met."""

    def __missing__(self, point: int) -> int | None:
        self[point] = out = None if unicodedata.category(chr(point))[0] == "M" else point
        return out


class _Kinds(dict):
    """translate() table: kept characters, a space for separators, nothing for the rest."""

    def __missing__(self, point: int) -> int | None:
        char = chr(point)
        if char.isalnum() or any(point in r for r in _ENCLOSED):
            out = point
        elif char in _SEPARATORS or (char.isspace() and point not in _NOT_SPACE):
            out = 0x20
        else:
            out = None
        self[point] = out
        return out


_marks, _kinds = _Marks(), _Kinds()


def normalize(text: str | None) -> str:
    """The fold of one string; None is empty."""
    if not text:
        return ""
    plain = unicodedata.normalize("NFKD", text).translate(_marks).lower()
    return " ".join(plain.translate(_kinds).split())


@F.pandas_udf(T.StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(normalize, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_all_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [normalize(t) for t in texts], na_action="ignore")


_ASCII_SPACE = r" \t\n\x0B\f\r"


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _fold_ascii(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), rf"[^a-z0-9{_ASCII_SPACE}\-.,()/]+", "")
    return F.trim(F.regexp_replace(kept, rf"[{_ASCII_SPACE}\-.,()/]+", " "))


def normalize_col(text: Column | str) -> Column:
    """The fold of a column; null stays null. ASCII rows are folded in the JVM and reach Python
    as nulls, so only other rows pay for the UDF's work."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(_ascii(text), _fold_ascii(text)).otherwise(_fold_udf(F.when(~_ascii(text), text)))


def normalize_array(texts: Column | str) -> Column:
    """The folds of an array's strings, null ones empty; a null array stays null."""
    texts = F.col(texts) if isinstance(texts, str) else texts
    texts = F.transform(texts, lambda t: F.coalesce(t, F.lit("")))
    plain = F.forall(texts, _ascii)
    return F.when(plain, F.transform(texts, _fold_ascii)).otherwise(_fold_all_udf(F.when(~plain, texts)))
