"""Cutting the lineage of a DataFrame through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, our own.

    Executors on other machines could not read the driver's own folder, so without a name that is an error there.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession) -> str:
    """The name of a new folder in the shared folder."""
    return f"{shared_base(spark).rstrip('/')}/lumenlake-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut: its rows are in the shared folder, so a lost executor costs no rerun."""
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in a new folder of the shared folder: packed more tightly than by durable(), for large results."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
