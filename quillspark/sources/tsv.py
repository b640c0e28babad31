"""Places from tab-separated text: gid, name, lat, lon, country, population, feature code, and
optionally aliases between ``|``.

Lines end with ``\\n`` (a ``\\r`` before it is dropped); empty lines and lines that begin with
``#`` are skipped but counted. The first bad line fails the whole read, with its number and
the field: nothing is dropped silently. A leading byte-order mark is removed by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import parse_unsigned
from ..operators.links import split_aliases

COLUMNS = 7
MAX_BYTES = 65_535
_FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


class LineError(ValueError):
    """A line that cannot be read; the message has its number and the field."""


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``(value, at, valid)``: lines that hold data; ``at`` numbers all lines of a task's share, and
    ``valid`` is whether the bytes are UTF-8 (later steps would repair them)."""
    lines = spark.read.text(path, lineSep="\n").withColumn("at", F.monotonically_increasing_id())
    bare = lines.withColumn("valid", F.expr("is_valid_utf8(value)")).withColumn("value", F.regexp_replace("value", r"[\r\n]+$", ""))
    return bare.where((F.col("value") != "") & ~F.col("value").startswith("#"))


def parse(lines: DataFrame) -> DataFrame:
    """Typed columns, ``aliases`` and ``error`` (the first field that is wrong, else null)."""
    cells = F.split("value", "\t", -1)
    cell = lambda k: F.try_element_at(cells, F.lit(k))
    # Java reads "Infinity" and "NaN" in that spelling only.
    number = lambda c: F.when(c.rlike(_FLOAT), F.when(c.rlike("(?i)nan"), F.lit(float("nan"))).when(c.rlike("(?i)^-inf"), F.lit(float("-inf"))).when(c.rlike("(?i)inf"), F.lit(float("inf"))).otherwise(c.try_cast("double")))
    whole = F.when(cell(6).rlike(r"^[+-]?[0-9]+$"), cell(6).try_cast("long"))
    typed = lines.select(
        "value", "at", "valid", F.size(cells).alias("cells"),
        parse_unsigned(cell(1)).alias("gid"), cell(2).alias("name"), number(cell(3)).alias("lat"), number(cell(4)).alias("lon"),
        cell(5).alias("country"), whole.alias("population"), cell(7).alias("feature_code"), split_aliases(cell(8), cell(2)).alias("aliases"),
    )
    long_ = lambda c: F.octet_length(c) > MAX_BYTES
    error = (
        F.when(~F.col("valid"), "text is not UTF-8")
        .when(F.col("cells") < COLUMNS, F.concat(F.lit(f"expected at least {COLUMNS} columns, found "), F.col("cells")))
        .when(F.col("gid").isNull(), "bad gid").when(F.col("lat").isNull(), "bad lat").when(F.col("lon").isNull(), "bad lon").when(F.col("population").isNull(), "bad population")
        .when(long_("name") | long_("country") | long_("feature_code"), "text field is too long")
    )
    return typed.withColumn("error", error)


def _line_number(spark: SparkSession, path: str, at: int) -> int:
    """Number in the file of the line that :func:`scan` numbered ``at``."""
    part, inside = at >> 33, at & ((1 << 33) - 1)
    lines = spark.read.text(path, lineSep="\n").withColumn("part", F.spark_partition_id())
    return inside + 1 + lines.where(F.col("part") < part).count()


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """The places with a ``record_id`` and ``aliases``; LineError on the first bad line."""
    parsed = parse(scan(spark, path))
    bad = parsed.where("error is not null").orderBy("at").limit(1).collect()
    if bad:
        raise LineError(f"line {_line_number(spark, path, bad[0]['at'])}: {bad[0]['error']}")
    return parsed.select(F.col("at").alias("record_id"), "gid", "name", "lat", "lon", "country", "population", "feature_code", "aliases")
