"""Dense hourly series for each (location, source network, destination)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net

KEY = ("location", "src_net", "dst_addr")


def hour_range(aggregates: DataFrame, step: int = 3600, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row (first, last): the hours that occur between the closed bounds; both null without any."""
    rows = aggregates
    if start is not None:
        rows = rows.where(F.col("time") >= start)
    if end is not None:
        rows = rows.where(F.col("time") <= end)
    return rows.agg(F.min("time").alias("first"), F.max("time").alias("last"))


def dense_series(aggregates: DataFrame, proto: int = net.UDP, step: int = 3600, start: int | None = None, end: int | None = None) -> DataFrame:
    """(location, src_net, dst_addr, total_packets): an element for each hour from the first to the last, 0 where nothing came.

    Keys of other protocols get a series too, of zeros. One grouping by key does it: the hours of a key (as many as the
    axis has at most) are sorted, and the zeros between them are put in, so no key meets the hours in a join and the work
    is linear in the axis. An hour that occurs twice for one key is an error.
    """
    own = F.when(F.col("proto") == proto, F.struct("time", "total_packets"))
    by_key = aggregates.groupBy(*KEY).agg(F.sort_array(F.collect_list(own)).alias("seen"))
    axis = hour_range(aggregates, step, start, end).where("first is not null")
    placed = by_key.crossJoin(F.broadcast(axis))  # the axis is one row
    on_axis = lambda x: (x["time"] >= F.col("first")) & (x["time"] <= F.col("last")) & (F.pmod(x["time"] - F.col("first"), F.lit(step)) == 0)
    placed = placed.select(*KEY, F.transform(F.filter("seen", on_axis), lambda x: F.struct(((x["time"] - F.col("first")) / step).cast("int").alias("k"), x["total_packets"].alias("v"))).alias("seen"), (F.expr(f"(last - first) div {int(step)}") + 1).cast("int").alias("n"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    at = lambda i: F.col("seen")[i]
    gap = lambda i: F.when(i == 0, at(i)["k"]).otherwise(at(i)["k"] - at(F.greatest(i - 1, F.lit(0)))["k"] - 1)
    filled = lambda i: F.concat(F.when(gap(i) < 0, F.raise_error(F.lit("an hour occurs twice")).cast("array<bigint>")).otherwise(zeros(gap(i))), F.array(at(i)["v"]))
    size = F.size("seen")
    dense = F.when(size == 0, zeros(F.col("n"))).otherwise(F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), filled)), zeros(F.col("n") - 1 - F.coalesce(F.try_element_at("seen", F.lit(-1))["k"], F.lit(0)))))
    return placed.select(*KEY, dense.alias("total_packets"))


def long_series(series: DataFrame) -> DataFrame:
    """(..., i, packets): a row for each hour, i from 1."""
    return series.select(*KEY, F.posexplode("total_packets").alias("pos", "packets")).select(*KEY, (F.col("pos") + 1).alias("i"), "packets")


def slice_stats(series: DataFrame, start: int, length: int) -> DataFrame:
    """Sum, maximum and active hours of one window of each series, on the arrays themselves."""
    part = F.slice("total_packets", start, length)
    total = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    return series.where(F.size("total_packets") >= start + length - 1).select(*KEY, total.alias("total"), F.array_max(part).alias("peak"), F.size(F.filter(part, lambda x: x > 0)).alias("active"))
