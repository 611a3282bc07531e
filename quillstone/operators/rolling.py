"""Row-count rolling windows over a *global* order without a single partition (A2).

``SUM(...) OVER (ORDER BY d ROWS BETWEEN k PRECEDING AND CURRENT ROW)`` with no
PARTITION BY makes Spark move every row into one partition. Here the rows are
range-partitioned by the whole order key once and written with their partition's
number, so that equal dates are no limit and every later step keeps the order:

1. rows are dealt into ``parts`` ranges of the order key, of about equal size;
2. the last ``k`` rows of every range form a small *tail* set: at most ``k * parts``
   rows, whatever the row count;
3. over the tails only, number them globally; the ``k`` rows preceding a
   range are the ``k`` tail rows just before the range's own tail. Each
   tail row is offered to the (at most ``k``) ranges whose tail starts within
   ``k`` positions after it - an equi join on the position, no range join;
4. those copies join their range as ghosts, the window runs
   ``partitionBy(range)``, ghosts are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def rolling_rows(df: DataFrame, order_cols: list[str], values: dict[str, Column], k: int,
                 parts: int | None = None) -> DataFrame:
    """For each row: the sum of each value expression over this row and the ``k`` rows
    before it in ``order_cols`` order, plus ``_rows`` (the number of rows in the frame).

    ``parts`` ranges (default: the session's shuffle partitions) are windowed independently.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "quillstone", f"rolling-{uuid.uuid4().hex}")
    (df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()]).repartitionByRange(parts, *order_cols)
     .withColumn("_bucket", F.spark_partition_id()).write.parquet(path))
    base = spark.read.parquet(path)
    order = [F.col(c) for c in order_cols]

    # (2) tails: last k rows of every range
    desc = Window.partitionBy("_bucket").orderBy(*[F.col(c).desc() for c in order_cols])
    vcols = [f"_v_{n}" for n in values]
    tails = base.select("_bucket", *order_cols, *vcols).withColumn("_rd", F.row_number().over(desc)) \
        .where(F.col("_rd") <= k).drop("_rd")
    # (3) global position over the tails only (at most k * parts rows)
    tails = tails.withColumn("_tp", F.row_number().over(Window.orderBy(*order)))
    starts = tails.groupBy("_bucket").agg(F.min("_tp").alias("_start"))
    offers = tails.select(F.explode(F.sequence(F.col("_tp") + 1, F.col("_tp") + k)).alias("_start"),
                          *order_cols, *vcols)
    ghosts = offers.join(starts, "_start").drop("_start").withColumn("_ghost", F.lit(True))

    # (4) window within a range
    real = base.withColumn("_ghost", F.lit(False))
    both = real.unionByName(ghosts, allowMissingColumns=True)
    w = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(-k, 0)
    out = both.select("*", *[F.sum(F.col(c)).over(w).alias(f"_sum_{c[3:]}") for c in vcols],
                      F.count(F.lit(1)).over(w).alias("_rows"))
    return out.where(~F.col("_ghost")).drop("_ghost", "_bucket", *vcols)


# ---------------------------------------------------------------- RANGE frames in event time

def running_sums(df: DataFrame, order_cols: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with the sum of each value over all rows up to this one in the order, as ``_run_<value>``.

    Rows are range-partitioned by the order once and written with their range's number; a
    range's sum is its own running sum plus the totals of the ranges before it (one row a range).
    Exact for integers and decimals.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "quillstone", f"running-{uuid.uuid4().hex}")
    df.repartitionByRange(parts, *order_cols).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    base = spark.read.parquet(path)
    totals = base.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values])
    within = Window.partitionBy("_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(v).over(within).alias(f"_l_{v}") for v in values])
    both = local.join(offsets, "_part")
    return both.select(*df.columns, *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"_run_{v}") for v in values])


def rolling_range(df: DataFrame, time: str, values: dict[str, Column], seconds: int, parts: int | None = None) -> DataFrame:
    """For each row: the sum of each value, and ``_rows``, over ``RANGE BETWEEN seconds PRECEDING AND CURRENT ROW`` of ``time``.

    Rows of one instant have one frame, so the rows are summed by instant first (a hot day or
    instant is combined map-side). An instant enters the frame at its time and leaves it
    ``seconds`` later: the frame's sum is the running sum over these two events, so nothing
    is copied from range to range, however wide the frame. Values are integers or
    decimals. Rows without a time have the frame of all rows without one.
    """
    names = list(values)
    per = df.select(F.col(time).alias("_t"), *[v.alias(n) for n, v in values.items()]).groupBy("_t").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.count(F.lit(1)).alias("_rows"))
    sums = [*names, "_rows"]
    enter = per.where("_t is not null").select("_t", F.lit(0).alias("_leaves"), *sums)
    leave = enter.select(F.timestamp_add("SECOND", F.lit(seconds), F.col("_t")).alias("_t"), F.lit(1).alias("_leaves"), *[(-F.col(s)).alias(s) for s in sums])
    run = running_sums(enter.unionByName(leave), ["_t", "_leaves"], sums, parts).where("_leaves = 0")
    frames = run.select("_t", *[F.col(f"_run_{s}").alias(f"_sum_{s}" if s != "_rows" else s) for s in sums])
    none = per.where("_t is null").select("_t", *[F.col(s).alias(f"_sum_{s}" if s != "_rows" else s) for s in sums])
    frames = frames.unionByName(none)
    return df.join(frames, df[time].eqNullSafe(frames["_t"])).drop("_t")
