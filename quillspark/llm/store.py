"""Tables that an operator writes between its steps.

They go to the folder that the driver and all executors share, see :func:`..runtime.scratch`,
so a lost executor costs a re-read and never a recomputation from lost local files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import scratch

__all__ = ["release", "scratch", "table", "written"]

def written(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and the frame that reads it.

    The plan of the result is a file scan: lineage ends here. The frame carries the path
    in ``_scratch_path`` so that :func:`release` can drop it once it has been used up.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame | str) -> None:
    """Deletes tables made by :func:`written` (or paths) that no later plan reads."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_scratch_path", None)
        if path:
            spark = SparkSession.active() if isinstance(table, str) else table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
