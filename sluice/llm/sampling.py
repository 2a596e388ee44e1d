"""Bounded training samples of labelled documents, chosen by a hash of their ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of more bytes than this are left out of training samples (never of scoring), so that those are bounded in bytes.
LONGEST = 32 << 10
_STEPS = 4096


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


def smallest(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` distinct rows (doc_id, ...): those whose ids have the smallest hashes, and nearly as many as that.

    No task sorts or gathers them: the hashes' range is cut into steps, which are counted (_STEPS counts reach the
    driver), and whole steps are taken from the smallest on while they fit.
    """
    every = ids.distinct()
    n = every.count()
    if n <= rows:
        return every
    width = min(1.0, 2.0 * rows / n) / _STEPS  # steps cover twice the share that is wanted
    place = F.floor(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 52)) / float(1 << 52) / width)
    counts = every.select(place.alias("step")).where(F.col("step") < _STEPS).groupBy("step").count().collect()
    end, total = 0, 0
    for row in sorted(counts):
        total += row["count"]
        if total > rows:
            break
        end = row["step"] + 1
    return every.where(place < end)


def texts_of(docs: DataFrame, chosen: DataFrame, longest: int = LONGEST) -> DataFrame:
    """chosen with each id's text, a row for each row of it whose text has `longest` bytes at most.

    `chosen` is a sample of bounded size, and is broadcast. Of several texts of one id the smallest counts, so repeated
    ids do not make the sample larger.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    return given.join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.min("text").alias("text"))
