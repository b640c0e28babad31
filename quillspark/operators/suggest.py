"""The query: keys that match, the best record of each group, rank order, the first few.

All functions take a covering table ``(key, group, rank, payload, ...)``: each link beside the
record it leads to, so a query joins nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import prefix_within
from ..functions.fold import normalize, normalize_col
from ..functions.order import merit, unsigned
from ..schema import DEFAULT_LIMIT, MAX_EDITS, EditBoundError

CORE = ("rank", "group", "payload")
#: Queries up to this many are sent to every task.
BROADCAST_QUERIES = 50_000
#: Queries (or their first characters) that are handed to the scan.
FEW_QUERIES = 200


def check(limit: int, max_edits: int) -> None:
    if limit < 0 or max_edits < 0:
        raise ValueError("limit and max_edits are not negative")


def matches(covering: DataFrame, folded: str, max_edits: int = 0) -> DataFrame:
    """Rows whose key begins with ``folded``, or has a prefix within so many edits of it and
    begins with its first character. Both predicates on the start of a key reach the scan."""
    if max_edits == 0:
        return covering.where(F.col("key").startswith(folded))
    return covering.where(F.col("key").startswith(folded[0]) & prefix_within(F.col("key"), F.lit(folded), max_edits))


def best_of_groups(hits: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """One record for each (``by``, group): the highest rank, then the least payload. An
    aggregate with a map-side part; several links to one record change nothing."""
    picked = F.min_by(F.struct(*(F.col(c) for c in ("rank", "payload", *extra))), merit()).alias("top")
    return hits.groupBy(*by, "group").agg(picked).select(*by, F.col("top.rank").alias("rank"), "group", F.col("top.payload").alias("payload"), *(F.col(f"top.{c}").alias(c) for c in extra))


def order() -> list[Column]:
    return [F.desc("rank"), F.asc("payload"), unsigned("group").asc()]


def suggest(covering: DataFrame, prefix: str, limit: int = DEFAULT_LIMIT, max_edits: int = 0, extra: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` suggestions, ``(rank, group, payload, *extra)`` in order.

    An empty fold or a limit of 0 gives nothing, whatever ``max_edits``; otherwise more than
    MAX_EDITS raises EditBoundError.
    """
    check(limit, max_edits)
    folded = normalize(prefix)
    if not folded or limit == 0:
        return covering.select(*CORE, *extra).where("false")
    if max_edits > MAX_EDITS:
        raise EditBoundError(f"max_edits is at most {MAX_EDITS}")
    return best_of_groups(matches(covering, folded, max_edits), extra=extra).orderBy(*order()).limit(limit)


def suggest_batch(covering: DataFrame, queries: DataFrame, query_col: str = "prefix", limit: int = DEFAULT_LIMIT, max_edits: int = 0, extra: Sequence[str] = ()) -> DataFrame:
    """Suggestions for each distinct value of ``queries[query_col]``: ``(query_col, pos, rank, group,
    payload, *extra)`` with pos from 1; queries that fold to nothing have none.

    Up to BROADCAST_QUERIES queries are read once and sent to all tasks; up to FEW_QUERIES of them
    reach the scan as predicates on the start of a key. Exact queries join on whole prefixes: each
    key is cut at the lengths that occur among the queries, and only cuts that are asked for live
    on. With edits :func:`near_keys` finds the keys of each query.
    """
    check(limit, max_edits)
    if limit and max_edits > MAX_EDITS:
        raise EditBoundError(f"max_edits is at most {MAX_EDITS}")
    asked = queries.select(F.col(query_col).cast("string").alias("asked")).distinct().withColumn("folded", normalize_col("asked")).where("folded <> ''")
    read = asked.limit(BROADCAST_QUERIES + 1).toArrow()
    small = read.num_rows <= BROADCAST_QUERIES
    side = F.broadcast if small else lambda x: x
    if small:
        asked = queries.sparkSession.createDataFrame(read)
        starts = set(read.column("folded").to_pylist()) if max_edits == 0 else {x[:1] for x in read.column("folded").to_pylist()}
        if len(starts) <= FEW_QUERIES:
            covering = covering.where(reduce(lambda a, b: a | b, (F.col("key").startswith(x) for x in sorted(starts)), F.lit(False)))
    folds = asked.select("folded").distinct()
    columns = ["group", "rank", "payload", *extra]
    lengths = sorted(r[0] for r in folds.select(F.char_length("folded")).distinct().collect())
    if max_edits == 0:
        cuts = F.array_distinct(F.array(*(F.substring("key", 1, n) for n in lengths or [1])))
        hits = covering.select(*columns, F.explode(cuts).alias("folded")).join(side(folds), "folded")
    else:
        near = near_keys(covering.select("key").distinct(), folds, lengths, max_edits, small)
        hits = covering.select("key", *columns).join(near, "key")
    best = best_of_groups(hits, ["folded"], extra)
    pos = F.row_number().over(W.partitionBy("folded").orderBy(*order()))
    top = best.withColumn("pos", pos.cast("long")).where(F.col("pos") <= limit)
    return top.join(side(asked), "folded").select(F.col("asked").alias(query_col), "pos", *CORE, *extra)


def near_keys(keys: DataFrame, folds: DataFrame, lengths: Sequence[int], max_edits: int, small: bool) -> DataFrame:
    """``(key, folded)``: distinct ``keys(key)`` that begin with a query's first character and have a
    prefix within so many edits of it; ``lengths`` are those of the distinct queries.

    A query is cut into max_edits + 1 pieces. So many edits leave one of them whole, and in the key
    it stands at most max_edits places off; keys and queries meet on the first character, the
    piece's number and the piece. Pairs are then verified. A query of at most max_edits characters
    is near every key that begins like it and needs no more.
    """
    side = F.broadcast if small else lambda x: x
    cut = [n for n in lengths if n > max_edits]
    head = F.substring("folded", 1, 1).alias("head")
    short = keys.withColumn("head", F.substring("key", 1, 1)).join(side(folds.where(F.char_length("folded") <= max_edits).select("folded", head)), "head").select("key", "folded")
    if not cut:
        return short
    spans = {n: [(n * k // (max_edits + 1), n * (k + 1) // (max_edits + 1)) for k in range(max_edits + 1)] for n in cut}
    of_query = reduce(lambda e, n: e.when(F.char_length("folded") == n, F.array(*(F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.substring("folded", a + 1, b - a).alias("part")) for k, (a, b) in enumerate(spans[n])))), cut, F)
    asked = folds.where(F.char_length("folded") > max_edits).select("folded", head, F.explode(of_query).alias("p")).select("folded", "head", "p.*")
    of_key = []
    for n in cut:
        for k, (a, b) in enumerate(spans[n]):
            for at in range(max(a - max_edits, 0), a + max_edits + 1):
                of_key.append(F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.substring("key", at + 1, b - a).alias("part")))
    pieces = keys.select("key", F.substring("key", 1, 1).alias("head"), F.explode(F.array_distinct(F.array(*of_key))).alias("p")).select("key", "head", "p.*")
    met = pieces.join(side(asked), ["head", "n", "k", "part"]).select("key", "folded").distinct()
    return short.unionByName(met.where(prefix_within(F.col("key"), F.col("folded"), max_edits)))


def materialized(covering: DataFrame, length: int, keep: int, extra: Sequence[str] = ()) -> DataFrame:
    """The first ``keep`` suggestions of every prefix of up to ``length`` characters that any key
    has: ``(prefix, pos, rank, group, payload, *extra)``. Groups are reduced to one record before
    the cut, so a look-up is exact for limits up to ``keep``."""
    cuts = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda n: F.substring(F.col("key"), F.lit(1), n))))
    best = best_of_groups(covering.select("group", "rank", "payload", *extra, cuts.alias("prefix")), ["prefix"], extra)
    pos = F.row_number().over(W.partitionBy("prefix").orderBy(*order()))
    return best.withColumn("pos", pos.cast("long")).where(F.col("pos") <= keep).select("prefix", "pos", *CORE, *extra)
