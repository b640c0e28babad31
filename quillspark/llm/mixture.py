"""Mixing sources to target weights, with DataFrame operations only.

A tree of levels (say domain, language, source) has a weight at each node. The budget in
tokens is handed down: a node gives each child its share by weight, but no more than the
child's subtree can give (its tokens times the epochs allowed); what a child cannot take
goes to its siblings by their weights, and only what a whole subtree cannot take is left to
the siblings of its ancestor, which see it as that subtree's limit. A leaf's budget is then
met by whole epochs and the token-prefix of one more, each epoch in its own seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Documents of a leaf's epoch that are put in order by one task, on average.
BUCKET_ROWS = 2000


def fill(nodes: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Adds ``share`` (long) to ``nodes(*parent, budget, child, weight, limit)``: the parent's
    budget by weight, each child at most its limit, the excess to siblings by weight.

    In ascending order of limit / weight the children at their limit come first: a child is
    one of them if a level at which it is full, met by all, stays within the budget. The rest
    share what is left by weight. Whole tokens: shares are rounded down and the remainder goes
    to the largest fractions, ties by name. Children of weight 0 get nothing.
    """
    group = list(parent) or [F.lit(0)]
    order = W.partitionBy(*group).orderBy(F.col("limit") / F.col("weight"), child)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    full = nodes.where("weight > 0").withColumns(
        {"taken": F.coalesce(F.sum("limit").over(before), F.lit(0)), "w_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))}
    )
    full = full.withColumn("is_full", F.col("taken") + F.col("limit") / F.col("weight") * F.col("w_left") <= F.col("budget") + 1e-6)
    full = full.withColumns(
        {"left": F.greatest(F.col("budget") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("limit"))).over(whole), F.lit(0)), F.lit(0)), "w_open": F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(whole)}
    )
    exact = F.col("left") * F.col("weight") / F.col("w_open")
    full = full.withColumns({"base": F.when(F.col("is_full"), F.col("limit")).otherwise(F.least(F.floor(exact), F.col("limit"))), "fraction": F.when(F.col("is_full"), F.lit(-1.0)).otherwise(exact - F.floor(exact))})
    full = full.withColumn("spare", F.least(F.col("budget"), F.sum("limit").over(whole)) - F.sum("base").over(whole))
    turn = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("fraction"), child))
    full = full.withColumn("share", (F.col("base") + F.when((turn <= F.col("spare")) & ~F.col("is_full") & (F.col("base") < F.col("limit")), 1).otherwise(0)).cast("long"))
    return full.select(*parent, child, "share")


def budgets(leaves: DataFrame, levels: Sequence[str], total: Column | int) -> DataFrame:
    """Budget of each leaf: ``leaves(*levels, tokens, limit, weight_<level>...)`` plus ``budget``.

    The weight of an inner node is read from any of its leaves' rows, which must agree.
    """
    plan = leaves.select(F.lit(total).cast("long").alias("budget")).limit(1)
    for depth, level in enumerate(levels):
        above, here = list(levels[:depth]), list(levels[: depth + 1])
        nodes = leaves.groupBy(*here).agg(F.sum("limit").alias("limit"), F.max(f"weight_{level}").alias("weight"))
        nodes = nodes.join(plan, above) if above else nodes.crossJoin(F.broadcast(plan))
        plan = written(fill(nodes, above, level).withColumnRenamed("share", "budget"), "mix-budget")
    return leaves.join(plan, list(levels))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, float]],
    total_share: float,
    max_epochs: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """The documents that meet the budgets, ``(id_col, mix_<level>..., epoch, n_tokens, take)``, a
    row for each document and epoch it is in; ``take`` is less than n_tokens only for the last
    document of a leaf, of which a prefix is taken.

    ``levels`` names the levels of the tree from the top and how a row gets each of them;
    ``weights[level][node]`` is a node's weight among its siblings, 1.0 if it is not listed.
    The budget is ``total_share`` of all tokens (white-space-separated words unless ``tokens``
    is given). A null level value is the node "" (its own leaf). Rows without tokens (null or
    empty texts) are never taken, nor are rows with a null id. Rows that repeat an id and a
    text are rows like any others; ties in the seeded order are broken by id, then n_tokens.
    """
    names = [f"mix_{level}" for level in levels]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_leaf(levels), _counted(tokens, text_col).alias("n_tokens"))
    rows = written(rows.where("n_tokens > 0 and id is not null"), "mix-rows")
    return _chosen(rows, levels, weights, total_share, max_epochs, seed).select(F.col("id").alias(id_col), *names, "epoch", "n_tokens", "take")


def _leaf(levels: dict[str, Column]) -> list[Column]:
    return [F.coalesce(column.cast("string"), F.lit("")).alias(f"mix_{level}") for level, column in levels.items()]


def _counted(tokens: Column | None, text_col: str) -> Column:
    return F.coalesce(tokens if tokens is not None else words(text_col), F.lit(0)).cast("long")


def _chosen(rows: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], total_share: float, max_epochs: int, seed: int) -> DataFrame:
    """``rows(id, mix_<level>..., n_tokens, ...)`` (stored) that meet the budgets, with epoch and take."""
    names = [f"mix_{level}" for level in levels]
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = leaves.withColumn("limit", F.col("tokens") * max_epochs)
    for level, name in zip(levels, names):
        listed = weights.get(level) or {}
        table = F.create_map(*(F.lit(x) for pair in listed.items() for x in pair)) if listed else None
        leaves = leaves.withColumn(f"weight_{name}", F.coalesce(F.try_element_at(table, F.col(name)), F.lit(1.0)) if table is not None else F.lit(1.0))
    leaves = written(leaves, "mix-leaves")
    total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * total_share)
    plan = budgets(leaves, names, total).select(*names, F.expr("cast(budget div tokens as int)").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"), F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("buckets"))
    plan = written(plan, "mix-plan")
    planned = rows.join(plan, names)

    whole = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    whole = whole.select(*rows.columns, "epoch", F.col("n_tokens").alias("take"))

    # The order of the last epoch is that of a seeded hash; its top bits deal a leaf's rows to
    # buckets, so a leaf of any size is put in order by many tasks.
    hashed = planned.where("rest > 0").withColumn("h", F.xxhash64(F.lit(seed), F.col("whole"), F.col("id")))
    hashed = hashed.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 32)) * F.col("buckets") / F.lit(float(1 << 32))).cast("long"))
    hashed = hashed.withColumn("h", F.shiftrightunsigned("h", 0).bitwiseXOR(F.lit(-(1 << 63))))
    sums = hashed.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    earlier = W.partitionBy(*names).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).drop("in_bucket")
    inside = W.partitionBy(*names, "bucket").orderBy("h", "id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = hashed.join(sums.where("true"), [*names, "bucket"]).where("before < rest")
    placed = placed.withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("at < rest")
    part = placed.select(*rows.columns, F.col("whole").alias("epoch"), F.least(F.col("n_tokens"), F.col("rest") - F.col("at")).alias("take"))
    return whole.unionByName(part)


def words(text_col: str) -> Column:
    """Number of white-space-separated words."""
    return F.regexp_count(F.col(text_col), F.lit(r"\S+"))


def prefix(text: Column, n: Column) -> Column:
    """The text up to its n-th white-space-separated word."""
    return F.array_join(F.slice(F.split(text, r"(?<=\S)(?=\s)"), F.lit(1), n.cast("int")), "")


def mixed(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, float]],
    total_share: float,
    max_epochs: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """The rows of ``docs`` that are taken, once for each epoch; the text of a leaf's last row
    is cut to the words taken of it. Columns stay those of ``docs``, whatever their names;
    n_chars, if there, follows. Rows are told apart by a number of their own, so rows that share
    an id, or are equal, are chosen one by one. Rows with a null id or without tokens are not taken.
    """
    own = [f"own_{k}" for k in range(len(docs.columns))]
    # Positions, as names may repeat those used here.
    held = docs.select(F.struct(*(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own))).alias("row"), F.col(id_col).cast("long").alias("id"), *_leaf(levels), _counted(tokens, text_col).alias("n_tokens"))
    held = written(held.where("n_tokens > 0 and id is not null").withColumn("key", F.monotonically_increasing_id()), "mix-docs")
    rows = held.select("key", "id", *(f"mix_{level}" for level in levels), "n_tokens")
    chosen = _chosen(rows, levels, weights, total_share, max_epochs, seed).select("key", "take")
    joined = held.select("key", "row.*", "n_tokens").join(chosen, "key")
    text = own[docs.columns.index(text_col)]
    part = F.col("take") < F.col("n_tokens")
    cut = prefix(F.col(text), F.col("take"))
    changed = {text_col: F.when(part, cut).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(part, F.char_length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own[docs.columns.index("n_chars")]))
    return joined.select(*(changed.get(c, F.col(o)).alias(c) for c, o in zip(docs.columns, own)))
