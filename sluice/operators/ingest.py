"""From flow records to packet counts by time bucket and source network.

Flows have: location, src_addr, dst_addr, proto, dst_port, first_us, last_us, in_packets, in_bytes. Addresses are BIGINT in
flows of IPv4 and BINARY in those of IPv6; a table has one family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net

#: Bucket lengths in seconds that stored aggregates may have.
INTERVALS = (60, 300, 900, 1800, 3600)


def bucket(seconds: Column, interval: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(interval))


def dns_flows(flows: DataFrame, networks: list | None = None, protocols: tuple[int, ...] | None = (net.TCP, net.UDP)) -> DataFrame:
    """Flows to port 53, of the given protocols (None: all), to any of the given networks (None: all)."""
    found = flows.where(F.col("dst_port") == net.DNS_PORT)
    if protocols is not None:
        found = found.where(F.col("proto").isin(*protocols))
    return found if networks is None else found.where(net.in_networks(flows, "dst_addr", networks))


def _gap_ns() -> Column:
    """Whole nanoseconds between the packets of a flow; 0 for a flow of one packet."""
    return F.when(F.col("in_packets") > 1, F.expr("((last_us - first_us) * 1000) div (in_packets - 1)")).otherwise(F.lit(0).cast("long"))


def valid_flows(flows: DataFrame) -> DataFrame:
    """The same rows; a flow without packets, or that ends before it starts, is an error."""
    ok = (F.col("in_packets") > 0) & (F.col("last_us") >= F.col("first_us"))
    return flows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a flow needs packets and a time order")).cast("boolean")))


def packets(flows: DataFrame) -> DataFrame:
    """A row for each packet, evenly spaced from first to last; bytes that do not divide go to the first one."""
    each = flows.withColumn("gap", _gap_ns()).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("in_packets") - 1)))
    time = F.col("first_us") * 1000 + F.col("i") * F.col("gap")
    size = F.expr("in_bytes div in_packets") + F.when(F.col("i") == 0, F.col("in_bytes") % F.col("in_packets")).otherwise(F.lit(0))
    return each.select("flow_id", "location", "src_addr", "dst_addr", "proto", "i", time.alias("time_ns"), size.cast("long").alias("bytes"))


def bucket_packets(flows: DataFrame, interval: int = 3600) -> DataFrame:
    """Flows with a row for each bucket they touch, `time`, and how many of their packets fall into it, `n`.

    Packet i is at first + i * gap, so those before a bound number ceil((bound - first) / gap), from 0 to all. The rows
    made grow with the buckets touched, not with the packets.
    """
    width = F.lit(interval * 1_000_000_000).cast("long")
    first = F.col("first_us") * 1000
    last = first + (F.col("in_packets") - 1) * F.col("gap")
    touched = F.sequence(first - F.pmod(first, width), last - F.pmod(last, width), width)

    def before(bound: Column) -> Column:
        more = bound - first + F.col("gap") - 1  # whole numbers throughout: x - x % gap is a multiple of gap
        count = ((more - more % F.col("gap")) / F.col("gap")).cast("long")
        return F.when(bound <= first, F.lit(0)).otherwise(F.least(count, F.col("in_packets")))

    each = flows.withColumn("gap", _gap_ns()).withColumn("start_ns", F.explode(touched))
    start, end = F.col("start_ns"), F.col("start_ns") + width
    n = F.when(F.col("gap") == 0, F.col("in_packets")).otherwise(before(end) - before(start))
    return each.withColumn("n", n.cast("long")).where("n > 0").withColumn("time", F.expr("start_ns div 1000000000")).drop("gap", "start_ns")


def aggregates(flows: DataFrame, interval: int = 3600, v4_prefix: int = 24, start: int = 0, end: int = (1 << 32) - 1, v6_prefix: int = 48) -> DataFrame:
    """Packets by (location, src_net, dst_addr, proto, time), for buckets in [start, end).

    The range is also put to whole flows, which a scan can skip.
    """
    if interval not in INTERVALS:
        raise ValueError(f"the interval is one of {INTERVALS}")
    near = flows.where((F.col("last_us") >= start * 1_000_000) & (F.col("first_us") < (end + interval) * 1_000_000))
    counted = bucket_packets(near, interval).where((F.col("time") >= start) & (F.col("time") < end))
    return counted.groupBy("location", net.network(flows, "src_addr", v4_prefix, v6_prefix).alias("src_net"), "dst_addr", "proto", "time").agg(F.sum("n").alias("total_packets"))


def merge(*parts: DataFrame) -> DataFrame:
    """Aggregates of several inputs, added up."""
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out.groupBy("location", "src_net", "dst_addr", "proto", "time").agg(F.sum("total_packets").alias("total_packets"))


def source_buckets(flows: DataFrame, interval: int = 3600, v4_prefix: int = 24, v6_prefix: int = 48) -> DataFrame:
    """Packets by (src_net, time) as the one-shot allowlist counts them.

    A flow within one bucket counts there at once, with no packets as well. Others are spread in floating point, as
    first + i * (last - first) / (n - 1); one packet across buckets counts where it starts.
    """
    first, last = F.col("first_us") / 1e6, F.col("last_us") / 1e6
    low, high = (bucket(F.floor(x), interval) for x in (first, last))
    one = (low == high) | (F.col("in_packets") == 1)
    at = first + F.col("i") * ((last - first) / (F.col("in_packets") - 1))
    places = F.when(one, F.array(F.lit(0).cast("long"))).when(F.col("in_packets") > 1, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("in_packets") - 1, F.lit(0))))
    time = F.when(one, low).otherwise(F.floor(at - at % interval))
    each = flows.withColumn("i", F.explode(places)).select(net.network(flows, "src_addr", v4_prefix, v6_prefix).alias("src_net"), time.alias("time"), F.when(one, F.col("in_packets")).otherwise(F.lit(1)).alias("n"))
    return each.groupBy("src_net", "time").agg(F.sum("n").alias("packets"))
