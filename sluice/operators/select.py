"""Parameter selection over evaluation results, and means under evasion.

Results have a row for each (location, dst_addr, attack_bandwidth, test_length, low_pass), parameters
(train_length, min_active, min_pkts_avg, above_limit) and window_start, with fpr and attack_traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import strict_mean

SERIES = ("location", "dst_addr", "attack_bandwidth", "test_length", "low_pass")
PARAMS = ("train_length", "min_active", "min_pkts_avg", "above_limit")


def rounded_limits(results: DataFrame) -> DataFrame:
    """The same rows with limits as parameters are keyed by them: the nearest whole number, halves away from zero."""
    return results.withColumn("above_limit", F.round("above_limit").cast("int"))


def last_written(results: DataFrame, order: str, *also: str) -> DataFrame:
    """One row for each configuration and window (and columns `also`): of repeated ones, that with the largest `order`."""
    key = [*also, *SERIES, *PARAMS, "window_start"]
    rest = [c for c in results.columns if c not in (*key, order)]
    return results.groupBy(*key).agg(*(F.max_by(c, order).alias(c) for c in rest))


def global_optimum(results: DataFrame) -> DataFrame:
    """The parameters of least mean false-positive rate for each series; of equal ones the smallest.

    The mean runs over starts 1, 1 + test_length, ... up to the first that is missing. A null rate makes a mean null, and
    null never wins; a series of nulls only has null parameters.
    """
    run = Window.partitionBy(*SERIES, *PARAMS).orderBy("window_start")
    stride = results.where("(window_start - 1) % test_length = 0").withColumn("nth", F.row_number().over(run) - 1)
    means = stride.where("nth = (window_start - 1) / test_length").groupBy(*SERIES, *PARAMS).agg(strict_mean("fpr").alias("avg_fpr"), F.avg("attack_traffic").alias("avg_attack_traffic"))
    best = Window.partitionBy(*SERIES).orderBy(F.col("avg_fpr").asc_nulls_last(), *PARAMS)
    won = means.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return won.select(*SERIES, "avg_fpr", F.when(F.col("avg_fpr").isNotNull(), F.col("avg_attack_traffic")).alias("avg_attack_traffic"), *(F.when(F.col("avg_fpr").isNotNull(), F.col(c)).alias(c) for c in PARAMS))


def day_forward(results: DataFrame) -> DataFrame:
    """Mean results of parameters chosen on the window before: of equal ones the largest.

    At x = 1 + test_length, 1 + 2 test_length, ... the parameters of least rate in the results of x - test_length are
    used at x. Windows without results on either side are left out.
    """
    stride = results.where("(window_start - 1) % test_length = 0")
    best = Window.partitionBy(*SERIES, "window_start").orderBy(F.col("fpr").asc_nulls_last(), *(F.col(c).desc() for c in PARAMS))
    chosen = stride.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(*SERIES, *PARAMS, (F.col("window_start") + F.col("test_length")).alias("window_start"))
    used = stride.join(chosen, [*SERIES, *PARAMS, "window_start"])
    return used.groupBy(*SERIES).agg(strict_mean("fpr").alias("avg_fpr"), F.avg("attack_traffic").alias("avg_attack_traffic"))


def dense_starts(results: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; a series whose starts are not 1 to n is an error."""
    seen = Window.partitionBy(*keys)
    whole = (F.max("window_start").over(seen) == F.count("*").over(seen)) & (F.min("window_start").over(seen) == 1)
    return results.withColumn("__whole", whole).where(F.when(F.col("__whole"), True).otherwise(F.raise_error(F.lit("a window is missing")).cast("boolean"))).drop("__whole")


def evasion_means(results: DataFrame) -> DataFrame:
    """Mean rate and attack traffic for each number of evading networks and each configuration, over all starts."""
    keys = ["location", "dst_addr", "evasion_ips", "attack_bandwidth", "test_length", "low_pass", *PARAMS]
    return dense_starts(results, keys).groupBy(*keys).agg(strict_mean("fpr").alias("fpr"), F.avg("attack_traffic").alias("attack_traffic"))


def evasion_lookup(means: DataFrame, order: Column | str = "attack_bandwidth") -> DataFrame:
    """One row for each location and number of evading networks; of several the last in order."""
    return means.groupBy("location", "evasion_ips").agg(F.max_by("fpr", order).alias("fpr"), F.max_by(F.col("attack_traffic") / 3600, order).alias("attack_per_second"))
