"""The tables behind the reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from .evaluate import SAMPLING


def peak_rates(aggregates: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(location, src_net, total_packets_max, total_packets_sum, active_hours) over stored rows of all protocols.

    The maximum is of single rows, which are per destination and protocol, not of a source's hourly totals.
    """
    rows = aggregates
    if start is not None:
        rows = rows.where(F.col("time") >= start)
    if end is not None:
        rows = rows.where(F.col("time") <= end)
    return rows.groupBy("location", "src_net").agg(F.max("total_packets").alias("total_packets_max"), F.sum("total_packets").alias("total_packets_sum"), F.count_distinct("time").alias("active_hours"))


def hourly_rates(peaks: DataFrame) -> DataFrame:
    """Peaks with estimated true rates: sums, averages over active hours and maxima, times the sampling factor."""
    rows = peaks.where("active_hours > 0 and location is not null")
    return rows.select("location", "src_net", "active_hours", (F.col("total_packets_sum") * SAMPLING).alias("pkts_sum"), (F.col("total_packets_sum") / F.col("active_hours") * SAMPLING).alias("pkts_avg"), (F.col("total_packets_max") * SAMPLING).alias("pkts_max"))


def sources_by_network(packets: DataFrame) -> DataFrame:
    """(src_net, n_sources): how many addresses of each /24 were seen."""
    return packets.groupBy(net.mask_v4(F.col("src_addr"), 24).alias("src_net")).agg(F.count_distinct("src_addr").alias("n_sources")).orderBy("src_net")


def linear_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The index of the equal bin between low and high; the last bin includes its end; null outside."""
    k = F.floor((value - low) / (high - low) * bins)
    return F.when((value >= low) & (value <= high), F.when(high == low, F.lit(bins // 2)).otherwise(F.least(k, F.lit(bins - 1)))).cast("int")


def log_edges(low: float, high: float, edges: int) -> list[float]:
    step = (math.log10(high) - math.log10(low)) / (edges - 1)
    return [10 ** (math.log10(low) + k * step) for k in range(edges)]


def edge_bin(value: Column, edges: list[float]) -> Column:
    """The index of the bin between given edges; the last bin includes its end; null outside."""
    array = F.array(*(F.lit(float(e)) for e in edges))
    k = F.size(F.filter(array, lambda e: e <= value)) - 1
    return F.when((value >= edges[0]) & (value <= edges[-1]), F.least(k, F.lit(len(edges) - 2)))


def rate_histogram(rates: DataFrame, column: str, x_bins: int = 324, edges: list[float] | None = None) -> DataFrame:
    """(location, x_bin, y_bin, n): sources by active hours (equal bins over each location's range) and by rate (log bins)."""
    edges = edges or log_edges(10, 10_000_000, 100)
    span = rates.groupBy("location").agg(F.min("active_hours").alias("low"), F.max("active_hours").alias("high"))
    binned = rates.join(F.broadcast(span), "location").select("location", linear_bin(F.col("active_hours"), F.col("low"), F.col("high"), x_bins).alias("x_bin"), edge_bin(F.col(column), edges).alias("y_bin"))  # a row a location
    return binned.where("x_bin is not null and y_bin is not null").groupBy("location", "x_bin", "y_bin").agg(F.count("*").alias("n"))


#: Bounds of the difference histograms (fixed values of the report).
TRAFFIC_EDGES = [-100000, -50000, -20000, -10000, -5000, -2000, -1000, 0, 1000, 2000, 5000, 10000, 20000, 50000, 100000]
FPR_EDGES = [-1.0, -0.5, -0.4, -0.3, -0.2, -0.15, -0.1, -0.08, -0.06, -0.05, -0.04, -0.03, -0.02, -0.01, 0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 1.0]


def difference_histogram(diffs: DataFrame, column: str, edges: list[float], x_step: int = 4, x_end: int = 700) -> DataFrame:
    """(location, dst_addr, x_bin, y_bin, n) of differences by how many windows after training they lie."""
    last = (x_end - 1) // x_step * x_step  # the last x edge
    x = F.when((F.col("idx") >= 0) & (F.col("idx") <= last), F.least(F.floor(F.col("idx") / x_step), F.lit(last // x_step - 1))).cast("int")
    binned = diffs.select("location", "dst_addr", x.alias("x_bin"), edge_bin(F.col(column), edges).alias("y_bin"))
    return binned.where("x_bin is not null and y_bin is not null").groupBy("location", "dst_addr", "x_bin", "y_bin").agg(F.count("*").alias("n"))


def borders(rates: DataFrame, column: str, thresholds: list[float], minima: list[int]) -> DataFrame:
    """(location, min_hours, threshold, border): how high a rate must be for its sources to carry that share of packets.

    Among sources with min_hours active hours or more, from the highest (rate, sum) down, the rate of the first at which
    the running sum reaches the share of the location's packets. Without one there is no row. Sums run over the distinct
    (rate, sum) pairs, so sources alike make one step.
    """
    total = rates.groupBy("location").agg(F.sum("pkts_sum").alias("all_packets"))
    of = F.filter(F.array(*(F.lit(m) for m in minima)), lambda m: m <= F.col("active_hours"))
    steps = rates.withColumn("min_hours", F.explode(of)).groupBy("location", "min_hours", F.col(column).alias("rate"), "pkts_sum").agg(F.sum("pkts_sum").alias("step"))
    down = Window.partitionBy("location", "min_hours").orderBy(F.col("rate").desc(), F.col("pkts_sum").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = steps.withColumn("carried", F.sum("step").over(down)).join(total, "location")
    wanted = running.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds)))).where("carried >= all_packets * threshold")
    return wanted.groupBy("location", "min_hours", "threshold").agg(F.max("rate").alias("border"))


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by, weighted_median): half of the weight lies on either side.

    A datum that weighs more than half wins at once. Otherwise, in order of (value, weight), the first at which the
    running weight passes half; where it is exactly half before, the mean with the one before. Non-positive weights
    only give null. Rows with null value or weight are left out.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    whole = Window.partitionBy(*by)
    order = whole.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    step = known.select(*by, F.col(value).alias("v"), F.col(weight).cast("double").alias("w"), (F.sum(weight).over(whole) * 0.5).alias("half"), F.sum(weight).over(order).alias("upto"), F.lag(value).over(whole.orderBy(value, weight)).alias("before"))
    own = F.when(F.abs(F.col("upto") - F.col("w") - F.col("half")) < 2.220446049250313e-16, (F.col("before") + F.col("v")) / 2).otherwise(F.col("v"))
    at = F.struct("upto", own.alias("m"))
    return step.groupBy(*by).agg(F.max(F.when(F.col("w") > F.col("half"), F.struct("w", "v"))).alias("heavy"), F.min(F.when(F.col("upto") > F.col("half"), at)).alias("middle")).select(*by, F.coalesce("heavy.v", "middle.m").alias("weighted_median"))


def summary(optima: DataFrame, by: tuple[str, ...] = ("test_length", "low_pass"), test_lengths: tuple[int, ...] = (8, 24, 72)) -> DataFrame:
    """Minimum, mean, median, weighted mean, weighted median and maximum of rates and of attack traffic in packets a second.

    A column `weight` weighs the rows; without it all weigh alike.
    """
    rows = optima.where(F.col("test_length").isin(*test_lengths)).withColumn("traffic", F.col("avg_attack_traffic") / 3600)
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(1.0))
    of = (("avg_fpr", "fpr"), ("traffic", "traffic"))
    plain = [f(c).alias(f"{n}_{short}") for c, short in of for f, n in ((F.min, "min"), (F.avg, "avg"), (F.median, "med"), (F.max, "max"))]
    mean = [F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))).alias(f"avgw_{short}") for c, short in of]
    # a group has a row for each series, of which there are few, so its values fit into an array
    pairs = [F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("weight").cast("double").alias("w"))))).alias(f"pairs_{short}") for c, short in of]
    out = rows.groupBy(*by).agg(*plain, *mean, *pairs)
    return out.select(*(c for c in out.columns if not c.startswith("pairs_")), *(_middle(F.col(f"pairs_{short}")).alias(f"medw_{short}") for _, short in of))


def _middle(pairs: Column) -> Column:
    """The weighted median, as weighted_median has it, of a sorted array of (v, w)."""
    weight = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x["w"])

    def chosen(x: Column) -> Column:
        rows, half = x["rows"], x["half"]
        heavy = F.array_max(F.transform(F.filter(rows, lambda r: r["w"] > half), lambda r: F.struct(r["w"], r["v"])))
        steps = F.transform(rows, lambda r, k: F.struct(weight(F.slice(rows, 1, k + 1)).alias("upto"), r["v"].alias("v"), r["w"].alias("w"), F.when(k > 0, F.try_element_at(rows, F.greatest(k, F.lit(1)))["v"]).alias("before")))
        first = F.filter(steps, lambda r: r["upto"] > half)
        own = lambda r: F.when(F.abs(r["upto"] - r["w"] - half) < 2.220446049250313e-16, (r["before"] + r["v"]) / 2).otherwise(r["v"])
        return F.coalesce(heavy["v"], F.try_element_at(F.transform(first, own), F.lit(1)))

    return net.let(F.struct(pairs.alias("rows"), (weight(pairs) * 0.5).alias("half")), chosen)


def churn(results: DataFrame, fixed_start: int = 1) -> DataFrame:
    """Difference series: each window against the one trained at `fixed_start`, by configuration.

    results: (keys..., window_start, fpr, attack_traffic) and the same evaluated with the fixed training window, as
    fixed_fpr and fixed_attack_traffic. idx counts windows from 0.
    """
    return results.select("*", (F.col("window_start") - fixed_start).alias("idx"), (F.col("fixed_fpr") - F.col("fpr")).alias("fpr_diff"), (F.col("fixed_attack_traffic") - F.col("attack_traffic")).alias("attack_diff"))


def matching(rows: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns each have one of the wanted values."""
    for column, values in wanted.items():
        rows = rows.where(F.col(column).isin(*values))
    return rows
