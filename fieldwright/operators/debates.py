"""Analytics over logged decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consensus(score: Column) -> Column:
    """Fixed value: borders of agreement."""
    return F.when(score >= 0.8, "strong").when(score >= 0.5, "split").otherwise("weak")


def value_report(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hit rate and cost by bucket and the given columns."""
    rate = F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 6)
    return df.groupBy(consensus(F.col("score")).alias("bucket"), *by).agg(F.count(F.lit(1)).alias("n"), rate.alias("hit_rate"), F.sum("cost").alias("cost"))


def worth_debating(margin: Column, wide: float = 0.15) -> Column:
    """Skip when the margin over the second choice is wide."""
    return margin < wide
