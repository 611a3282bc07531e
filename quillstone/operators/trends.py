"""Spend trend z-scores (T1-T4) over the (month, segment) series of A1.

The window input has one row per (month, segment), partitioned by segment.

T1 reproduces the original: rolling mean and *population* std over 3 rows
including the current one. With n points including the current one,
``|z| <= sqrt(n - 1)``, so with 3 rows ``|z| <= 1.414`` and T1 never flags at
threshold 2. T2 is the intended "against the 3 prior months" form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_label, safe_std


def spend_trend(monthly: DataFrame, window: int = 3, threshold: float = 2.0) -> DataFrame:
    """Current row included; std 0 -> machine epsilon."""
    w = Window.partitionBy("segment").orderBy("month").rowsBetween(-(window - 1), 0)
    mean, sd = F.avg("total_spent").over(w), F.stddev_pop("total_spent").over(w)
    out = monthly.select("month", "segment", "total_spent", mean.alias("rolling_mean"), sd.alias("_sd"))
    out = out.withColumn("rolling_std", safe_std(F.col("_sd"))).drop("_sd")
    out = out.withColumn("z_score", (F.col("total_spent") - F.col("rolling_mean")) / F.col("rolling_std"))
    return out.withColumn("flag", F.abs("z_score") > F.lit(threshold))


def spend_trend_prior(monthly: DataFrame, window: int = 3, threshold: float = 2.0) -> DataFrame:
    """Against the ``window`` rows before the current one; no history or std 0 -> null z."""
    w = Window.partitionBy("segment").orderBy("month").rowsBetween(-window, -1)
    out = monthly.select("month", "segment", "total_spent", F.avg("total_spent").over(w).alias("rolling_mean"),
                         F.stddev_pop("total_spent").over(w).alias("rolling_std"))
    z = F.when(F.col("rolling_std") > 0, (F.col("total_spent") - F.col("rolling_mean")) / F.col("rolling_std"))
    out = out.withColumn("z_score", z)
    return out.withColumn("flag", F.coalesce(F.abs("z_score") > F.lit(threshold), F.lit(False)))


def trend_flagged(trend: DataFrame) -> DataFrame:
    """Flagged rows, 2 digits, month label."""
    return trend.where(F.col("flag")).select(
        month_label("month").alias("month"), "segment", F.round("total_spent", 2).alias("total_spent"),
        F.round("z_score", 2).alias("z_score"))


def trend_ranked(trend: DataFrame) -> DataFrame:
    """T4: flagged first, then |z| descending, with a level."""
    az = F.abs("z_score")
    level = F.when(F.col("flag"), "CRITICAL FLAG").when(az >= 1, "MONITOR").otherwise("NORMAL")
    return (trend.select(month_label("month").alias("month"), "segment", F.round("total_spent", 2).alias("total_spent"),
                         F.round("z_score", 4).alias("z_score"), "flag", level.alias("level"), az.alias("_az"))
            .orderBy(F.desc("flag"), F.desc_nulls_last("_az"), "month", "segment").drop("_az"))
