"""Orders of records: rank downwards, payload bytes upwards, group as an unsigned number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOP = -(1 << 63)


def unsigned(group: Column | str) -> Column:
    """A sort key that orders the 64 bits of ``group`` as an unsigned number."""
    group = F.col(group) if isinstance(group, str) else group
    return group.bitwiseXOR(F.lit(_TOP))


def to_unsigned(group: int) -> int:
    return group & ((1 << 64) - 1)


def to_signed(group: int) -> int:
    if not 0 <= group < 1 << 64:
        raise ValueError(f"{group} is not an unsigned 64-bit number")
    return group - (1 << 64) if group >> 63 else group


def parse_unsigned(text: Column) -> Column:
    """64 bits of a decimal string, null if it is none (no blanks, an optional plus)."""
    number = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("decimal(38,0)"))
    wrapped = F.when(number >= F.lit(str(1 << 63)).cast("decimal(38,0)"), number - F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(number)
    return F.when(number < F.lit(str(1 << 64)).cast("decimal(38,0)"), wrapped).cast("long")


def merit(rank: Column | str = "rank", payload: Column | str = "payload") -> Column:
    """Sorts the better record first: ~rank falls as rank rises, without overflow."""
    return F.struct(F.bitwise_not(rank).alias("worse"), F.col(payload).alias("payload") if isinstance(payload, str) else payload)
