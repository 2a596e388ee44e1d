"""An extra beyond batch work: hourly source counts and allowlists from a stream of flow records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..operators.ingest import bucket_packets
from ..operators.prototype import Configuration, allowlist_of


def source_hours(flows: DataFrame, delay: str = "2 hours", interval: int = 3600, v4_prefix: int = 24) -> DataFrame:
    """(src_net, time, packets), each hour once, after the watermark has passed it. Flows later than `delay` are left out."""
    spread = bucket_packets(flows, interval).withColumn("at", F.timestamp_seconds("time"))
    counted = spread.withWatermark("at", delay).groupBy(F.window("at", f"{interval} seconds").alias("w"), net.mask_v4(F.col("src_addr"), v4_prefix).alias("src_net"))
    return counted.agg(F.sum("n").alias("packets")).select("src_net", F.unix_seconds("w.start").alias("time"), "packets")


def refresh(hours: DataFrame, config: Configuration, path: str, use: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that appends closed hours to `path` and hands the allowlist as of the newest hour to `use`.

    A batch is written to a folder of its own number, so a batch that is repeated after a failure replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        seen = spark.read.schema("src_net bigint, time bigint, packets bigint, batch bigint").parquet(path)
        newest = seen.agg(F.max("time").alias("t")).first()["t"]
        if newest is not None:
            use(allowlist_of(seen, config, newest + config.aggregation_time))

    return hours.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).start()
