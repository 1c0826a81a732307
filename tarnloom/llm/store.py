"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts lineage and survives the loss of any executor, which cached
blocks and local checkpoints do not.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..storage import new_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tarnloom_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete the shuffle files of plans that are done.

    It does so when the driver collects the plans as garbage, which a driver with a large
    heap may not do for hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
