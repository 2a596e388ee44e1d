"""Detection metrics over columns tp, tn, fp, fn (and total). Empty denominators give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TP, TN, FP, FN = "tp", "tn", "fp", "fn"


def fpr() -> Column:
    return F.try_divide(F.col(FP), F.col(FP) + F.col(TN))


def fnr() -> Column:
    return F.try_divide(F.col(FN), F.col(FN) + F.col(TP))


def f_beta(beta: float = 1.0) -> Column:
    b = beta * beta
    return F.try_divide((1 + b) * F.col(TP), (1 + b) * F.col(TP) + b * F.col(FP) + F.col(FN))


def balanced_accuracy() -> Column:
    return (F.try_divide(F.col(TP), F.col(TP) + F.col(FN)) + F.try_divide(F.col(TN), F.col(TN) + F.col(FP))) / 2


def normalised(df: DataFrame) -> DataFrame:
    """The four sums as shares of the total, and the total as 1."""
    return df.withColumns({c: F.try_divide(F.col(c), F.col("total")) for c in (TP, TN, FP, FN, "total")})


def strict_mean(column: Column | str) -> Column:
    """The mean, or null if any value is null: a missing measurement is not left out silently."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(column) == F.count(F.lit(1)), F.avg(column))


