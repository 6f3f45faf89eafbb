"""Broadcasts behind a count, tasks by their work, and plans that the JVM compiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it is broadcast.
ROWS = 20_000


def small(table: DataFrame, most: int = ROWS) -> DataFrame:
    """The table, marked for broadcast if it has no more than so many rows; else as it is, and a join shuffles it."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def tasks(spark: SparkSession, work: int | None, most: int) -> int:
    """How many tasks share so much work, each `most` at most.  For steps that make many more rows than they read, which would
    go to a few tasks by their bytes."""
    return max(spark.sparkContext.defaultParallelism, math.ceil((work or 0) / most))


def compiled(spark: SparkSession) -> None:
    """The JVM never compiles methods of more than 8000 bytes, and interprets them; with this limit Spark runs such a stage
    operator by operator, in shorter ones.  Set for the session."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
