"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; a temporary one only where it names none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="factloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/factloom/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
