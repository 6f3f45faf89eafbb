"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; with a local master a folder of this session if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, suffix: str = "") -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}{suffix}"


def plain_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path for files that are opened without Spark; the shared folder must be a mounted one."""
    path = new_path(spark, suffix)
    if re.match(r"(?!file:)[a-z0-9]+:", path):
        raise ValueError(f"{path} is in a store that only Spark can open")
    return re.sub(r"^file:(//)?", "", path)


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: its lineage ends there."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
