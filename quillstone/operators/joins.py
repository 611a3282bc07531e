"""Join forms.

Joins are never forced to broadcast: Spark (and AQE at run time) broadcasts a
side whose measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
uses sort-merge beyond it; AQE splits skewed sort-merge partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_inner(left: DataFrame, right: DataFrame, keys: list[str] | str) -> DataFrame:
    """J1."""
    return left.join(right, keys, "inner")


def left_join_where(left: DataFrame, right: DataFrame, keys: list[str] | str, right_pred: Column) -> DataFrame:
    """LEFT JOIN ... ON keys AND <predicate on the right side>.

    The predicate goes into the right scan (unmatched left rows are kept). The right
    side may have hot keys, which a left outer join cannot split; so the matches are an
    inner join, whose skewed partitions AQE splits on either side, and the left rows
    without a match an anti join with the right side's distinct keys, which are
    aggregated before they are shuffled.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    right = right.where(right_pred)
    matched = left.join(right, names, "inner")
    alone = left.join(right.select(*names).distinct(), names, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def join_left(left: DataFrame, *rights: tuple[DataFrame, list[str] | str]) -> DataFrame:
    """A chain of left outer joins."""
    out = left
    for r, k in rights:
        out = out.join(r, k, "left")
    return out


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent (nulls included, as ``NOT IN`` a set)."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep rows whose id is in ``ids`` (semi join)."""
    return df.join(ids.select(key), key, "left_semi")


def with_previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str],
                  bucket: Column | None = None) -> DataFrame:
    """The previous row's columns within each key (``lag``; no self join).

    Without ``bucket`` this is one window partition per key. With ``bucket``
    (an expression of the first order column that preserves the order, e.g.
    ``date_trunc('day', ts)``) a key is split into one window partition per
    bucket, so a hot key spreads over many tasks:

    1. ``lag`` inside (key, bucket) is right for every row but a bucket's first;
    2. the last row of every (key, bucket) comes from an aggregate
       (``max_by`` on the order, combined map-side, so hot keys are cheap);
    3. a window over those per-bucket rows (one row per bucket of a key) gives
       each bucket the last row of the previous non-empty bucket;
    4. that row is joined on (key, bucket), which the window already
       partitioned the big side by, and used for the bucket's first row.
    """
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols})
    b = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    b = b.withColumns({f"_lag_{c}": F.lag(c).over(w) for c in cols}).withColumn(
        "_first", F.row_number().over(w) == 1)
    okey = F.struct(*[F.col(o) for o in order])
    last = b.groupBy(*keys, "_bkt").agg(*[F.max_by(F.col(c), okey).alias(f"_last_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy("_bkt")
    carry = last.select(*keys, "_bkt", *[F.lag(f"_last_{c}").over(wb).alias(f"_carry_{c}") for c in cols])
    out = b.join(carry, [*keys, "_bkt"], "left")
    return out.withColumns({f"prev_{c}": F.when(F.col("_first"), F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}"))
                            for c in cols}).drop("_bkt", "_first", *[f"_lag_{c}" for c in cols],
                                                 *[f"_carry_{c}" for c in cols])
