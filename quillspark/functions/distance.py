"""Edit distance between a query and the nearest prefix of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_within(key: Column, query: Column, most: int) -> Column:
    """Whether some prefix of ``key`` is within ``most`` edits of ``query``, by code points. A prefix within ``most`` edits differs in length by
    at most that, so 2 * most + 1 prefixes decide; levenshtein stops at the threshold."""
    size = F.char_length(query)
    tries = [F.levenshtein(F.substring(key, F.lit(1), F.greatest(size + d, F.lit(0))), query, most) >= 0 for d in range(-most, most + 1)]
    return reduce(lambda a, b: a | b, tries)
