"""Walk-forward backtest: every period is forecast from the periods before it, and from nothing else.

The training windows expand, and what a fit needs from its window are sums.  So one pass adds
each period's sums, a running total over periods gives the sums of every window at once, and the
fits are arithmetic on these few rows: no self-join of history, no model fit a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fits(rows: DataFrame, period: str, x: str, y: str, by: str | None = None) -> DataFrame:
    """(by, period, n_before, mean, slope, intercept) from all earlier periods of the same ``by``.

    Null x or y teach nothing.  A period without an earlier row has none; where x never varied, the
    slope is 0.  x and y should be decimals, so that sums are exact and do not depend on order."""
    keys = [c for c in (by, period) if c]
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(period).isNotNull())
    sums = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
    )
    # one row a period (and key): the window's partition is as long as the history has periods
    before = Window.partitionBy(*([by] if by else [])).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.select(*keys, *[F.sum(c).over(before).cast("double").alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]).where("n > 0")
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)
    fit = run.withColumns({"slope": slope, "mean": F.col("sy") / F.col("n")})
    return fit.select(*keys, F.col("n").cast("long").alias("n_before"), "mean", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))


def backtest(rows: DataFrame, period: str, x: str, y: str, by: str | None = None) -> DataFrame:
    """(by, period, n, n_before, mae, mae_mean, bias): errors of the fit beside those of the plain mean
    of the past.  Rows of the first period of a key, and rows without x or y, are not judged."""
    keys = [c for c in (by, period) if c]
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    off = F.col(y).cast("double") - (F.col("intercept") + F.col("slope") * F.col(x).cast("double"))
    judged = known.join(fits(rows, period, x, y, by), keys).withColumns({"off": off, "off_mean": F.col(y).cast("double") - F.col("mean")})
    return judged.groupBy(*keys, "n_before").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("off")).alias("mae"),
        F.avg(F.abs("off_mean")).alias("mae_mean"),
        F.avg("off").alias("bias"),
    )
