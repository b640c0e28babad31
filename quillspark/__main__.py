"""``python -m quillspark IN.tsv OUT_DIR``: builds a stored index of places."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    """0 if the index was built, 1 if not, 2 for a wrong call."""
    if len(args) != 2:
        print("usage: python -m quillspark IN.tsv OUT_DIR", file=sys.stderr)
        return 2
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from quillspark.plans.index import build_places
    from quillspark.runtime import ship

    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    ship(spark)
    try:
        made = build_places(spark, *args)
    except (OSError, ValueError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(f"{made['records']} records, {made['all_links']} links, {made['keys']} keys, build {made['build']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
