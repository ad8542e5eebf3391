"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; a local one only where the setting is missing and the
    session runs on one machine, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="metalith-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        top = "file://" + local
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/metalith-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for what many branches of a plan read: it is not computed again in each, its size is
    known to the planner, and lost executors cost nothing of it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables; results that were not written yet need them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
