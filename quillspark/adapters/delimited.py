"""People: group is a person, rank a score, payload ``name|department`` in UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(*fields: Column | str, separator: str = "|") -> Column:
    return F.encode(F.concat_ws(separator, *(F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit("")) for f in fields)), "utf-8")


def decode(payload: Column | str, *names: str, separator: str = "|") -> Column:
    parts = F.split(F.decode(payload, "utf-8"), rf"\Q{separator}\E", len(names))
    return F.struct(*(F.try_element_at(parts, F.lit(k + 1)).alias(n) for k, n in enumerate(names)))
