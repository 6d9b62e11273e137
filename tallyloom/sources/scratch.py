"""Tables written in between, in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder, as a URI, under ``spark.checkpoint.dir``, removed when the application ends.

    Only a local master may do without that setting, as in tests: it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    conf = spark._jsc.hadoopConfiguration()
    if "://" not in base and not base.startswith("file:") and spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(conf).getScheme() == "file":
        base = f"file://{os.path.abspath(base)}"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(conf)
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: each value is computed once, and outlives the executor that computed it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
