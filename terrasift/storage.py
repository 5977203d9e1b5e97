"""Tables that a loop writes and reads again, on storage that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Without one only a session on one machine (tests)
    gets a folder of its own; a cluster has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = tempfile.mkdtemp(prefix="terrasift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and written: its lineage ends there, and no lost executor loses it."""
    path = f"{shared_dir(df.sparkSession)}/terrasift/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
