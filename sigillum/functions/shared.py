"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names. Where it names none, an own one in local mode only:
    on a cluster a folder of one machine would not do."""
    named = spark.conf.get(SETTING, None)
    if named is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sigillum-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again.

    Cuts the lineage: nothing before it runs again, whatever executor is lost.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
