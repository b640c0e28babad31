"""Links from keys to records, and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fold import normalize_array


def alias_links(records: DataFrame, aliases: Column | str, name: Column | str, id_col: str = "record_id") -> DataFrame:
    """``(key, record_id)``, one row for each alias that folds to a non-empty key (duplicates
    stay); a record none of whose aliases does is linked by its folded name, if that is not
    empty. Null aliases and names count as empty."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    every = F.concat(F.coalesce(column(aliases), F.array().cast("array<string>")), F.array(column(name)))
    folded = records.select(F.col(id_col).alias("record_id"), normalize_array(every).alias("folds"))
    own = F.filter(F.slice("folds", F.lit(1), F.size("folds") - 1), lambda k: k != "")
    keys = folded.select("record_id", own.alias("own"), F.element_at("folds", -1).alias("name"))
    chosen = F.when(F.size("own") > 0, F.col("own")).otherwise(F.filter(F.array("name"), lambda k: k != ""))
    return keys.select(F.explode(chosen).alias("key"), "record_id")


def split_aliases(column: Column | str, name: Column | str) -> Column:
    """Pieces between ``|`` that are not empty; the name alone where the column is null or empty."""
    column, name = (F.col(c) if isinstance(c, str) else c for c in (column, name))
    pieces = F.filter(F.split(column, r"\|"), lambda x: x != "")
    return F.when(F.coalesce(column, F.lit("")) == "", F.array(name)).otherwise(pieces)


def distinct_links(links: DataFrame) -> DataFrame:
    return links.select("key", "record_id").distinct()


def postings(links: DataFrame) -> DataFrame:
    """``(key, record_ids)``: the sorted distinct ids of each key."""
    return links.groupBy("key").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"))


#: Characters of a key by which :func:`numbered_postings` deals keys to windows.
PART = 3


def numbered_postings(links: DataFrame) -> DataFrame:
    """:func:`postings` with each key's place in the order of keys, from 0. Keys are
    numbered among those with the same first characters and shifted by the number of keys before
    them; the only window over everything has one row for each PART characters."""
    keys = postings(links).withColumn("part", F.substring("key", 1, PART))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = keys.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("key")) - 1
    return keys.withColumn("inside", inside).join(shifts, "part").select((F.col("shift") + F.col("inside")).cast("long").alias("ordinal"), "key", "record_ids")


#: Keys that are put in order at once to find one by its place.
FEW_KEYS = 10_000


def key_at(keys: DataFrame, ordinal: int) -> str | None:
    """The key at this place in the order of distinct ``keys(key)``. Counts of keys by their first
    characters, one character more each time, lead to the few that are put in order."""
    prefix = ""
    while True:
        own = keys.where(F.col("key").startswith(prefix))
        groups = own.groupBy(F.substring("key", 1, len(prefix) + 1).alias("head")).agg(F.count("*").alias("n")).orderBy("head").collect()
        for head, n in groups:
            if ordinal < n:
                break
            ordinal -= n
        else:
            return None
        # The prefix itself is a key that no longer one hides.
        if head == prefix and prefix:
            return head
        if n <= FEW_KEYS:
            return own.where(F.col("key").startswith(head)).orderBy("key").offset(ordinal).limit(1).first()[0]
        prefix = head


def dangling(links: DataFrame, records: DataFrame) -> DataFrame:
    """Links to records that don't exist."""
    return links.join(records.select("record_id"), "record_id", "left_anti")
