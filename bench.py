"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans import queries as Q
from quillspark.plans.index import SuggestIndex
from quillspark.runtime import ship

REPEATS = 3


def timed(run, repeats: int = REPEATS) -> float:
    """Median of some runs after a first that isn't counted."""
    run()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return sorted(took)[len(took) // 2]


def all_rows(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    out: dict[str, float] = {}
    extra: dict[str, float] = {}

    docs = Q.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("group"), F.col("n_chars").alias("rank"), F.encode("lang", "utf-8").alias("payload"))
    with tempfile.TemporaryDirectory() as folder:
        began = time.perf_counter()
        manifest = SuggestIndex.from_frames(docs, Q.terms(spark, sf_dir), validate=False).write(folder)
        out["build_terms_index"] = time.perf_counter() - began
        extra |= {"links": manifest["links"], "keys": manifest["keys"], "links_per_sec": round(manifest["links"] / out["build_terms_index"])}
        extra["stored_bytes"] = sum(p.stat().st_size for p in Path(folder, manifest["build"]).rglob("*.parquet"))
        index = SuggestIndex.open(spark, folder)
        out["suggest_stored"] = timed(lambda: index.suggest("th").collect())
        out["suggest_fuzzy_stored"] = timed(lambda: index.suggest("anitble", max_edits=2).collect())
        keys = index.links.select("key").distinct()
        # Three plans: predicates in the scan, a broadcast, a join of two large sides.
        for n in (10, 1000, 100_000):
            asked = keys.select(F.substring("key", 1, 8).alias("prefix")).distinct().orderBy(F.xxhash64("prefix")).limit(n).cache()
            count = asked.count()
            out[f"suggest_batch_{n}"] = timed(lambda: all_rows(index.suggest_batch(asked)))
            extra |= {f"prefixes_{n}": count, f"prefixes_per_sec_{n}": round(count / out[f"suggest_batch_{n}"])}
        asked = keys.orderBy(F.xxhash64("key")).limit(1000).select(F.substring("key", 1, 6).alias("prefix")).distinct().cache()
        count = asked.count()
        out["suggest_batch_fuzzy_1000"] = timed(lambda: all_rows(index.suggest_batch(asked, max_edits=1)))
        extra |= {"prefixes_fuzzy_1000": count, "prefixes_per_sec_fuzzy_1000": round(count / out["suggest_batch_fuzzy_1000"])}
        cached = index.covering.cache()
        cached.count()
        warm = SuggestIndex(index.records, index.links, cached)
        out["suggest_cached"] = timed(lambda: warm.suggest("th").collect())
        out["suggest_fuzzy_cached"] = timed(lambda: warm.suggest("anitble", max_edits=2).collect())
        spark.catalog.clearCache()
    for name in ("fold_documents", "suggest_part", "fuzzy_2", "suggest_group_dedup", "suggest_batch_terms", "topk_prefix_materialized", "postings_terms"):
        out[name] = timed(lambda: all_rows(Q.QUERIES[name](spark, sf_dir)))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": {k: round(v, 4) for k, v in out.items()}, "sf": Path(sf_dir).name, **extra}))


if __name__ == "__main__":
    main()
