"""The one-shot allowlist: sources that were present often and at least once heavy in the window before `now`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net
from .ingest import dns_flows, source_buckets


@dataclass(frozen=True)
class Configuration:
    destination_addresses: tuple[str, ...] = field(default=("0.0.0.0/0", "::/0"))
    aggregation_time: int = 3600
    ipv4_aggregation: int = 24
    ipv6_aggregation: int = 48
    param_w_train: int = 24
    param_steady: int = 3
    param_heavy: int = 128


def allowlist_of(buckets: DataFrame, config: Configuration, now: int) -> DataFrame:
    """(src_net, packets) of sources with `param_steady` buckets or more, the largest of `param_heavy` or more.

    The window starts `param_w_train` buckets before the bucket of `now` and ends at `now` itself, so one more bucket
    takes part where `now` lies within it. Zero counts count as present.
    """
    start = now - now % config.aggregation_time - config.aggregation_time * config.param_w_train
    seen = buckets.where((F.col("time") >= start) & (F.col("time") < now)).groupBy("src_net").agg(F.count("*").alias("n"), F.max("packets").alias("packets"))
    return seen.where((F.col("n") >= config.param_steady) & (F.col("packets") >= config.param_heavy)).select("src_net", "packets")


def one_shot_allowlist(flows: DataFrame, config: Configuration, now: int) -> DataFrame:
    """(ip, packets) from flows of any protocol, of one family, to port 53 of the configured destinations."""
    kept = dns_flows(flows, net.networks(list(config.destination_addresses)), None)
    buckets = source_buckets(kept, config.aggregation_time, config.ipv4_aggregation, config.ipv6_aggregation)
    found = allowlist_of(buckets, config, now)
    return found.select(net.text_of(found, "src_net").alias("ip"), "packets")
