"""Attack traffic: from attackers' weights to packets an hour at each location and destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net

BITS_PER_PACKET = 800
SECONDS = 3600


def weights_by_network(attackers: DataFrame, prefix: int = 24) -> DataFrame:
    """(src_net, weight) from (src_addr, weight) of either family, by one prefix."""
    return attackers.groupBy(net.network(attackers, "src_addr", prefix, prefix).alias("src_net")).agg(F.sum("weight").alias("weight"))


def attack_rates(weights: DataFrame, bits_per_second: int) -> DataFrame:
    """(src_net, rate): each network's share of the attack, in packets of 100 bytes an hour."""
    total = weights.agg(F.sum("weight").alias("total_weight"))  # one row
    per_hour = bits_per_second * float(SECONDS) / BITS_PER_PACKET
    return weights.crossJoin(F.broadcast(total)).groupBy("src_net").agg(F.sum(F.lit(per_hour) / F.col("total_weight") * F.col("weight")).alias("rate"))


def catchment_matches(nets: DataFrame, spans: DataFrame, prefix: int = 24, block_bits: int = 16) -> DataFrame:
    """nets with the entry of the catchment that holds them, if any: `entry` and null otherwise.

    An entry spans the addresses `start` to `end`, gaps inside included, and entries do not overlap. It holds a network
    that begins where it does, or lies behind its start and ends no later. Entries are cut into blocks of addresses, so
    that the range condition comes with an equality to join on.
    """
    blocks = spans.select("entry", "start", "end", F.explode(F.sequence(F.shiftright("start", block_bits), F.shiftright("end", block_bits))).alias("block"))
    low, high = F.col("src_net"), net.broadcast_v4(F.col("src_net"), prefix)
    holds = (F.col("start") == low) | ((F.col("start") < low) & (F.col("end") >= high))
    found = nets.withColumn("block", F.shiftright("src_net", block_bits)).join(blocks, "block").where(holds).select("src_net", "entry").distinct()
    return nets.join(found, "src_net", "left")


def attack_by_location(rates: DataFrame, targets: DataFrame, catchment: DataFrame | None = None, prefix: int = 24) -> DataFrame:
    """(location, dst_addr, src_net, attack) for each target (location, dst_addr).

    catchment: (entry, start, end, dst_addr, location, factor). Where the entry that holds a network knows the
    destination, its rate is multiplied by the location's factor, and locations it does not name get nothing. Elsewhere
    the rate is split evenly among the destination's locations.
    """
    shares = targets.groupBy("dst_addr").agg(F.count("*").alias("locations"))
    # the service's locations and destinations are a handful that does not grow with the traffic: one row holds them
    places = targets.join(shares, "dst_addr").agg(F.collect_list(F.struct("location", "dst_addr", "locations")).alias("places"))
    every = lambda nets: nets.crossJoin(F.broadcast(places)).select(*nets.columns, F.inline("places"))
    if catchment is None:
        return every(rates).select("location", "dst_addr", "src_net", (F.col("rate") / F.col("locations")).alias("attack"))
    matched = catchment_matches(rates.select("src_net").distinct(), catchment.select("entry", "start", "end").distinct(), prefix)
    knows = catchment.select("entry", "dst_addr").distinct().withColumn("known", F.lit(True))
    pairs = every(rates.join(matched, "src_net"))
    joined = pairs.join(knows, ["entry", "dst_addr"], "left").join(catchment.select("entry", "dst_addr", "location", "factor"), ["entry", "dst_addr", "location"], "left")
    scaled = F.when(F.col("known"), F.col("rate") * F.col("factor")).otherwise(F.col("rate") / F.col("locations"))
    return joined.select("location", "dst_addr", "src_net", scaled.alias("attack")).where("attack is not null")
