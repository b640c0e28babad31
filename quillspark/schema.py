"""Column names and types that all modules agree on."""

from pyspark.sql import types as T

#: ``group`` holds the 64 bits of an unsigned number; see functions.order.
RECORD = T.StructType([
    T.StructField("record_id", T.LongType(), False),
    T.StructField("group", T.LongType(), False),
    T.StructField("rank", T.LongType(), False),
    T.StructField("payload", T.BinaryType(), False),
])
LINK = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("record_id", T.LongType(), False)])
GEO = T.StructType([
    T.StructField("gid", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("country", T.StringType(), False),
    T.StructField("population", T.LongType(), False),
    T.StructField("feature_code", T.StringType(), False),
])

MAX_EDITS = 2
DEFAULT_LIMIT = 8


class IndexFormatError(IOError):
    """Stored data that is missing, of another version, or contradicts itself."""


class EditBoundError(ValueError, IOError):
    """More edits asked for than the engine allows."""
