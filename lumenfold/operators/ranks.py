"""Exact order statistics and percentiles of columns of any size, without a task that holds them.

Of one column, or a few groups: one pass takes each group's number, least and greatest value.  While the values between the
bounds of a rank are more than `most`, a pass counts them in `CELLS` equal cells and the bounds
close in on the cells that hold the rank; then the values that are left, at most `most` of a
group, are sorted.  Groups are few (bands, columns): their counts pass through the driver.

Of any number of groups, of any size each (`Sorted`): all values are numbered once in the order of
(group, value), so a rank of a group is a number, and a join by numbers fetches it.  Groups stay
a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordinals

CELLS = 1024
MOST = 1 << 18


def order_statistics(df: DataFrame, column: str, wanted, by: str | None = None, most: int = MOST) -> dict:
    """{group: (n, {rank: value})} of the known values of df's column: the values at the ranks
    (from 0, in ascending order) that wanted(n) lists.  by: a column of groups, else one group None."""
    spark = df.sparkSession
    group = F.col(by).cast("string") if by else F.lit("")
    rows = df.select(group.alias("g"), F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    out, open_ = {}, []
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    ends = [F.count("*"), F.count_if(F.col("x") == float("-inf")), F.count_if(F.col("x") == float("inf")), F.min(finite), F.max(finite)]
    for g, n, under, over, low, high in rows.groupBy("g").agg(*ends).collect():
        ranks = sorted({r for r in wanted(n) if 0 <= r < n})
        out[g] = (n, {r: -math.inf if r < under else math.inf for r in ranks if r < under or r >= n - over})
        ranks = tuple(r for r in ranks if under <= r < n - over)
        if ranks:
            open_.append((g, ranks, n - under - over, under, low, high))  # ranks that lie in [low, high], which holds so many values; `under` others are less
    last = []
    while open_:
        wide = []
        for task in open_:
            g, ranks, n, _, low, high = task
            if low == high:
                out[g][1].update(dict.fromkeys(ranks, low))
            else:
                (wide if n > most else last).append(task)
        if not wide:
            break
        state = spark.createDataFrame([(i, g, low, high) for i, (g, _, _, _, low, high) in enumerate(wide)], "i int, g string, low double, high double")
        met = rows.join(F.broadcast(state), "g").where("x >= low and x <= high")
        # halves, as a difference of great values can leave the range
        share = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        cell = F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
        cells: dict[int, list] = {}
        for i, c, k, low, high in met.groupBy("i", cell.alias("c")).agg(F.count("*"), F.min("x"), F.max("x")).collect():
            cells.setdefault(i, []).append((c, k, low, high))
        open_ = []
        for i, (g, ranks, _, below, _, _) in enumerate(wide):
            left = list(ranks)
            for _, k, low, high in sorted(cells[i]):
                inside = tuple(r for r in left if r < below + k)
                if inside:
                    open_.append((g, inside, k, below, low, high))
                    left = left[len(inside) :]
                below += k
    if last:
        state = spark.createDataFrame([(i, g, low, high) for i, (g, _, _, _, low, high) in enumerate(last)], "i int, g string, low double, high double")
        kept = rows.join(F.broadcast(state), "g").where("x >= low and x <= high").groupBy("i").agg(F.sort_array(F.collect_list("x")).alias("v"))
        places = spark.createDataFrame([(i, r - below, r) for i, (_, ranks, _, below, _, _) in enumerate(last) for r in ranks], "i int, at long, rank long")
        for i, r, x in kept.join(F.broadcast(places), "i").select("i", "rank", F.get("v", F.col("at").cast("int"))).collect():
            out[last[i][0]][1][r] = x
    return {(g if by else None): v for g, v in out.items()}


def percentiles(df: DataFrame, column: str, shares: list[float], by: str | None = None, most: int = MOST) -> dict:
    """{group: (n, [value at each share])}, with values between two ranks interpolated."""

    def ranks(n):
        return [r for p in shares for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    out = {}
    for g, (n, at) in order_statistics(df, column, ranks, by, most).items():
        values = []
        for p in shares:
            place = p * (n - 1)
            low, high = at[math.floor(place)], at[math.ceil(place)]
            values.append(low + (high - low) * (place - math.floor(place)))
        out[g] = (n, values)
    return out


def long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, x) of several columns, for percentiles by name in the same passes."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select("c.*")


class Sorted:
    """The known values of df's column in the order of (by, value): `groups` has by and n."""

    def __init__(self, df: DataFrame, column: str, *by: str):
        x = F.col(column).cast("double")
        known = df.select(*by, x.alias("_x")).where("_x is not null and not isnan(_x)")
        self.by = list(by)
        self.rows = ordinals.numbered(known, *by, "_x", name="_nth")
        self._starts = self.rows.groupBy(*by).agg(F.min("_nth").alias("_start"), F.count("*").alias("n"))
        self.groups = self._starts.drop("_start")

    def at(self, ranks: dict[str, Column], settings: DataFrame | None = None) -> DataFrame:
        """by, n and the values at these ranks (from 0; columns over n and the columns of settings(by, ...)); null
        where a group has no such rank."""
        groups = self._starts if settings is None else self._starts.join(settings, self.by)
        asked = groups.select(*self.by, "_start", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), r.cast("long").alias("r")) for k, r in ranks.items()])).alias("_a"))
        asked = asked.select(*self.by, "n", "_a.k", F.when(F.col("_a.r").between(0, F.col("n") - 1), F.col("_start") + F.col("_a.r")).alias("_nth"))
        met = asked.join(self.rows.select("_nth", "_x"), "_nth", "left")
        return met.groupBy(*self.by, "n").agg(*[F.max(F.when(F.col("k") == k, F.col("_x"))).alias(k) for k in ranks])

    def percentiles(self, shares: dict[str, float]) -> DataFrame:
        """by, n and the values at these shares of n - 1, those between two ranks interpolated."""
        place = {k: F.lit(s) * (F.col("n") - 1) for k, s in shares.items()}
        ends = {f"_{end}_{k}": f(p) for k, p in place.items() for end, f in (("lo", F.floor), ("hi", F.ceil))}
        got = self.at(ends)
        share = {k: p - F.floor(p) for k, p in place.items()}
        low, high = (lambda k: F.col(f"_lo_{k}")), (lambda k: F.col(f"_hi_{k}"))
        return got.select(*self.by, "n", *[(low(k) + (high(k) - low(k)) * share[k]).alias(k) for k in shares])


def medians(df: DataFrame, column: str, *by: str) -> DataFrame:
    """by, n and median of each group."""
    return Sorted(df, column, *by).percentiles({"median": 0.5})
