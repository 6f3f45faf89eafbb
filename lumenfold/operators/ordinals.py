"""Row numbers of a total order, by a prefix sum over ranges that are written once.

Rows are ranged by the order's columns (and by a spread of their own, so that rows that tie in all of
them, even all rows of a table, don't land in one range), sorted within ranges and written to the shared
folder with their place: the range and the place in it.  All that follows reads those files.  A
range's number is its rows' place plus the rows of the ranges before; these sums are one
number for each range.  Ranging again could draw other bounds, so nothing is evaluated twice.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

_IN_RANGE = 33  # bits of monotonically_increasing_id() for the place in a partition


def placed(rows: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """rows, written in this order, with _range and _place (from 0 in each range)."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_spread"]
    # a hash of the place where a row was read: any order of rows that tie is right
    spread = rows.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    inside = spread.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_spread")
    inside = inside.withColumn("_at", F.monotonically_increasing_id())
    at = F.col("_at")
    return shared.written(inside).withColumns({"_range": F.shiftright(at, _IN_RANGE), "_place": at.bitwiseAND(F.lit((1 << _IN_RANGE) - 1))}).drop("_at")


def numbered(rows: DataFrame, *order: str, name: str = "observation_id", ranges: int | None = None) -> DataFrame:
    """rows with their number from 0 in this order; rows that tie in all its columns in any order."""
    ranged = placed(rows, *order, ranges=ranges)
    sizes = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.count("*")).collect())  # a number for each range
    starts = accumulate((n for _, n in sizes), initial=0)
    table = rows.sparkSession.createDataFrame([(r, s) for (r, _), s in zip(sizes, starts)], "_range long, _start long")
    out = ranged.join(F.broadcast(table), "_range").withColumn(name, F.col("_start") + F.col("_place"))
    return out.select(*rows.columns, name)


def starts(groups: DataFrame, key: str, size: str, name: str = "start", ranges: int | None = None) -> DataFrame:
    """key, and the sum of the sizes of all groups before it in the order of key, a key being one row: where the numbers of its rows
    begin.  So rows that know their place in their group are numbered without being sorted."""
    ranged = placed(groups.select(key, F.col(size).cast("long").alias("_size")), key, ranges=ranges)
    sums = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.sum("_size")).collect())  # a number for each range
    before = accumulate((n for _, n in sums), initial=0)
    table = groups.sparkSession.createDataFrame([(r, s) for (r, _), s in zip(sums, before)], "_range long, _start long")
    inside = F.sum("_size").over(Window.partitionBy("_range").orderBy("_place")) - F.col("_size")
    return ranged.withColumn("_inside", inside).join(F.broadcast(table), "_range").select(key, (F.col("_start") + F.col("_inside")).alias(name))
