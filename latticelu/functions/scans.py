"""Prefix sums, compensated sums and block coordinates as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1 << 16


def exclusive_scan(df: DataFrame, key: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """`df` plus the sum of `value` over all smaller keys; keys are whole numbers.

    Two levels: sums within runs of `width` keys, and a scan over the runs' totals, of
    which there is one for each `width` keys.  No partition holds all rows.
    """
    run = F.floor(F.col(key) / width)
    rows = df.withColumn("_run", run)
    totals = rows.groupBy("_run").agg(F.sum(value).alias("_total"))
    before = totals.select("_run", F.coalesce(F.sum("_total").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(before, "_run").withColumn(out, F.col("_own") + F.col("_before")).drop("_run", "_own", "_before")


def balanced_ranges(counts: DataFrame, key: str, count: str, ranges: int, out: str = "part") -> DataFrame:
    """Keys dealt to contiguous ranges of about equal summed count."""
    scanned = exclusive_scan(counts, key, count, "_below")
    total = counts.agg(F.sum(count).alias("_all"))
    part = F.least(F.floor(F.col("_below") * ranges / F.greatest(F.col("_all"), F.lit(1))), F.lit(ranges - 1)).cast("int")
    return scanned.crossJoin(F.broadcast(total)).withColumn(out, part).drop("_below", "_all")


def kahan_sum(values: Column) -> Column:
    """Compensated sum of an array of doubles, in the array's order."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost"))

    def step(state: Column, x: Column) -> Column:
        y = x - state["lost"]
        t = state["sum"] + y
        return F.struct(t.alias("sum"), ((t - state["sum"]) - y).alias("lost"))

    return F.aggregate(values, zero, step, lambda s: s["sum"])


def norm2(vec: DataFrame, value: str = "v", key: str = "i", width: int = WIDTH) -> DataFrame:
    """One row, norm: compensated sums of squares over runs of keys, then of the runs."""
    runs = vec.groupBy(F.floor(F.col(key) / width).alias("run")).agg(F.array_sort(F.collect_list(F.struct(key, value))).alias("x"))
    part = runs.select("run", kahan_sum(F.transform("x", lambda p: p[value] * p[value])).alias("s"))
    return part.agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "s"))), lambda p: p["s"]).alias("s")).select(F.sqrt(kahan_sum(F.col("s"))).alias("norm"))


def block_of(index: Column, nb: int) -> Column:
    return F.floor(index / nb).cast("int")


def in_block(index: Column, nb: int) -> Column:
    return F.pmod(index, F.lit(nb)).cast("int")


def process_grid(processes: int) -> tuple[int, int]:
    """(p, q): p the largest divisor of `processes` up to its square root."""
    if processes < 1:
        raise ValueError("there must be a process")
    p = max(d for d in range(1, int(processes**0.5) + 1) if processes % d == 0)
    return p, processes // p


def owner(bi: Column, bj: Column, p: int, q: int) -> Column:
    """Rank of a block in a two-dimensional block-cyclic layout."""
    return F.pmod(bi, F.lit(p)) * q + F.pmod(bj, F.lit(q))
