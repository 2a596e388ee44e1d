"""Statistics of all sliding windows, and what is made from them: allowlists and traffic intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY, long_series

#: Window lengths in hours, and the minima of the allowlists (fixed values of the experiment).
TRAIN_LENGTHS = (1, 2, 4, 8, 12, 24, 25, 48, 49, 72, 73)
ACTIVE_MINIMA = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
PACKET_MINIMA = (4, 8, 16, 32, 64, 128, 256)


def window_stats(series: DataFrame, lengths: tuple[int, ...] = TRAIN_LENGTHS) -> DataFrame:
    """(location, src_net, dst_addr, time_start, train_window, total, active, average) of every window with traffic.

    time_start counts hours from 1. One running sum over a sort by key and hour serves all lengths: a window is the
    difference of two of its values, so the work does not grow with the lengths. The average is over active hours only.
    Windows that reach beyond the series, and those without traffic, have no row.
    """
    order = Window.partitionBy(*KEY).orderBy("i")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    hours = long_series(series).select(*KEY, "i", F.sum("packets").over(sofar).alias("c"), F.sum((F.col("packets") > 0).cast("int")).over(sofar).cast("int").alias("a"))

    def stats(t: int):
        before = lambda c: F.coalesce(F.lag(c, t).over(order), F.lit(0))
        return F.struct(F.lit(t).alias("train_window"), (F.col("c") - before("c")).alias("total"), (F.col("a") - before("a")).cast("int").alias("active"))

    each = hours.select(*KEY, "i", F.array(*(stats(t) for t in lengths)).alias("windows"))
    flat = each.select(*KEY, "i", F.inline("windows")).where("i >= train_window and active > 0")
    return flat.select(*KEY, (F.col("i") - F.col("train_window") + 1).alias("time_start"), "train_window", "total", "active", (F.col("total") / F.col("active")).alias("average"))


GROUP = ("location", "dst_addr", "time_start", "train_window")


def allowlist_rows(stats: DataFrame, active_minima: tuple[int, ...] = ACTIVE_MINIMA, packet_minima: tuple[int, ...] = PACKET_MINIMA) -> DataFrame:
    """A row for each source and each pair of minima that it meets; only pairs met are made."""
    enough = stats.where((F.col("average") >= min(packet_minima)) & (F.col("active") >= min(active_minima)))
    of = lambda values, c: F.filter(F.array(*(F.lit(v) for v in values)), lambda v: v <= F.col(c))
    return enough.withColumn("active_min", F.explode(of(active_minima, "active"))).withColumn("pkts_min", F.explode(of(packet_minima, "average"))).select(*GROUP, "active_min", "pkts_min", "src_net")


def allowlists(stats: DataFrame, active_minima: tuple[int, ...] = ACTIVE_MINIMA, packet_minima: tuple[int, ...] = PACKET_MINIMA) -> DataFrame:
    """Each allowlist as a sorted array of networks."""
    return allowlist_rows(stats, active_minima, packet_minima).groupBy(*GROUP, "active_min", "pkts_min").agg(F.array_sort(F.collect_set("src_net")).alias("srcs"))


def traffic_intervals(stats: DataFrame) -> DataFrame:
    """For each window, its sources and their averages as two arrays in one order."""
    paired = F.array_sort(F.collect_list(F.struct("src_net", "average")))
    return stats.groupBy(*GROUP).agg(paired.alias("p")).select(*GROUP, F.col("p.src_net").alias("iprange_srcs"), F.col("p.average").alias("pkts_avgs"))


def lookup_intervals(wanted: DataFrame, intervals: DataFrame, missing: str = "error") -> DataFrame:
    """The interval of each wanted (location, dst_addr, time_start, train_window); a missing one is an error or is empty."""
    if missing not in ("error", "empty"):
        raise ValueError("missing is 'error' or 'empty'")
    found = wanted.join(intervals, list(GROUP), "left")
    if missing == "empty":
        return found.withColumns({c: F.coalesce(c, F.array().cast(intervals.schema[c].dataType)) for c in ("iprange_srcs", "pkts_avgs")})
    there = F.when(F.col("iprange_srcs").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no traffic interval for "), F.to_json(F.struct(*GROUP)))).cast("boolean"))
    return found.where(there)


def lookup_allowlists(wanted: DataFrame, lists: DataFrame) -> DataFrame:
    """The allowlist of each wanted window and pair of minima; a missing one is empty, and `listed` says so."""
    found = wanted.join(lists, [*GROUP, "active_min", "pkts_min"], "left")
    return found.withColumn("listed", F.col("srcs").isNotNull()).withColumn("srcs", F.coalesce("srcs", F.array().cast("array<bigint>")))
