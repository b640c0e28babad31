"""Products: group is a product, rank its sales, payload JSON; variants are keys of one record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(**fields: Column | str) -> Column:
    named = (F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in fields.items())
    return F.encode(F.to_json(F.struct(*named)), "utf-8")


def decode(payload: Column | str, schema: str) -> Column:
    return F.from_json(F.decode(payload, "utf-8"), schema)


def keys(name: Column | str, variants: Column | str) -> Column:
    """The name, and the name with each variant."""
    name, variants = (F.col(c) if isinstance(c, str) else c for c in (name, variants))
    return F.array_union(F.array(name), F.transform(F.coalesce(variants, F.array()), lambda v: F.concat_ws(" ", name, v)))
