"""Comparing all rows of a bucket with each other, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialise, spread_join


def deal(rows: DataFrame, key: list[str], item: str, tile: int) -> DataFrame:
    """rows with `part` and `other`: those that share key, part and other are to be compared, all against all.

    A bucket (rows of one key) of up to `tile` rows stays whole. A larger one is cut into parts by a hash of `item`, and
    each part meets each other part once, so every pair of rows meets somewhere and no task gets more than two parts.
    The rows of very large buckets learn the number of parts in several tasks.
    """
    size = materialise(rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > tile), "large")
    hot = hot_keys(size, rows.count())
    known = size.select(*key, F.ceil(F.col("__n") / tile).cast("int").alias("parts"))
    dealt = spread_join(rows, known, key, "left", hot).withColumn("own", F.pmod(F.xxhash64(item), F.coalesce("parts", F.lit(1))).cast("int"))
    meets = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")))
    dealt = dealt.withColumn("with", F.explode(meets))
    return dealt.withColumn("part", F.least("own", "with")).withColumn("other", F.greatest("own", "with")).drop("own", "with", "parts")


def shuffled(rows: DataFrame, key: list[str], item: str, tile: int, rounds: int = 2) -> DataFrame:
    """rows with `part` and `other`, as deal gives them, but a large bucket is only split at random, `rounds` times over.

    Every row meets about `tile` others each time. Where all rows of a bucket are alike, this links all of them in linear time.
    """
    size = materialise(rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > tile), "large")
    hot = hot_keys(size, rows.count())
    known = size.select(*key, F.ceil(F.col("__n") / tile).cast("int").alias("parts"))
    dealt = spread_join(rows, known, key, "left", hot)
    turns = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(rounds - 1)))
    dealt = dealt.withColumn("other", F.explode(turns))
    return dealt.withColumn("part", F.pmod(F.xxhash64(item, "other"), F.coalesce("parts", F.lit(1))).cast("int")).select(*rows.columns, "part", "other")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices through the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def groups(batches, key: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by key, one table for each key."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        columns = [rows.column(k).to_numpy() for k in key]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        at = 0
        for edge in edges.tolist():
            yield rows.slice(at, edge - at)
            at = edge
        held = rows.slice(at)
    if held is not None:
        yield held
