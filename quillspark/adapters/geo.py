"""Places as records: gid is the group, population the rank.

Payload: latitude and longitude as little-endian doubles, then country, feature code and
name, each a little-endian 16-bit length and that many bytes of UTF-8.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import to_unsigned
from ..schema import IndexFormatError

TYPED = ("name", "lat", "lon", "country", "feature_code")


def pack(lat: float, lon: float, country: str, feature_code: str, name: str) -> bytes:
    out = [struct.pack("<dd", lat, lon)]
    for text in (country, feature_code, name):
        data = text.encode("utf-8")
        if len(data) > 0xFFFF:
            raise ValueError("a text field takes at most 65535 bytes")
        out.append(struct.pack("<H", len(data)) + data)
    return b"".join(out)


def unpack(payload: bytes) -> tuple[float, float, str, str, str]:
    """lat, lon, country, feature code, name; bytes after them are ignored."""
    try:
        lat, lon = struct.unpack_from("<dd", payload)
        at, texts = 16, []
        for _ in range(3):
            (size,) = struct.unpack_from("<H", payload, at)
            data = payload[at + 2 : at + 2 + size]
            if len(data) < size:
                raise IndexFormatError("place payload ends early")
            texts.append(data.decode("utf-8"))
            at += 2 + size
        return lat, lon, *texts
    except (struct.error, UnicodeDecodeError) as error:
        raise IndexFormatError(f"bad place payload: {error}") from error


def geo_unpack(rank: int, group: int, payload: bytes) -> tuple:
    """gid, name, lat, lon, country, population, feature code of one hit."""
    lat, lon, country, code, name = unpack(payload)
    return to_unsigned(group), name, lat, lon, country, rank, code


@F.pandas_udf(T.BinaryType())
def _encode(lat: pd.Series, lon: pd.Series, country: pd.Series, code: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([pack(*row) for row in zip(lat, lon, country, code, name)])


_FIELDS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("lat", "lon")] + [T.StructField(n, T.StringType()) for n in ("country", "feature_code", "name")])


@F.pandas_udf(_FIELDS)
def _decode(payload: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unpack(bytes(p)) for p in payload], columns=["lat", "lon", "country", "feature_code", "name"])


def encode(country: Column | str = "country", code: Column | str = "feature_code", name: Column | str = "name") -> Column:
    return _encode("lat", "lon", country, code, name)


def decode(payload: Column | str = "payload") -> Column:
    """Struct of the payload's fields; a malformed payload fails the query."""
    return _decode(payload)


def records(places: DataFrame) -> DataFrame:
    """Neutral records with the typed columns beside the payload, so that queries need not decode."""
    return places.select("record_id", F.col("gid").alias("group"), F.col("population").alias("rank"), encode().alias("payload"), *TYPED)


def places(hits: DataFrame) -> DataFrame:
    """Hits as typed rows, in the order of the hits."""
    if set(TYPED) <= set(hits.columns):
        return hits.select(F.col("group").alias("gid"), "name", "lat", "lon", "country", F.col("rank").alias("population"), "feature_code")
    row = hits.withColumn("place", decode())
    return row.select(F.col("group").alias("gid"), "place.name", "place.lat", "place.lon", "place.country", F.col("rank").alias("population"), "place.feature_code")
