"""Customer segmentation (G1, G2): a ``when`` chain, no UDF."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SEGMENT_DEFAULTS, segment_of, with_defaults


def segment_customers(customers: DataFrame, run_ts: _dt.datetime | None = None) -> DataFrame:
    """G1: one segment per customer; absent input columns take the documented defaults."""
    c = with_defaults(customers, SEGMENT_DEFAULTS)
    assigned = F.lit(run_ts or _dt.datetime(2000, 1, 1)).cast("timestamp_ntz")
    return c.select("customer_id", segment_of().alias("segment"), assigned.alias("assigned_at"))


def segment_breakdown(segments: DataFrame) -> DataFrame:
    """Customers per segment."""
    return segments.groupBy("segment").agg(F.count(F.lit(1)).alias("customers")).orderBy(F.desc("customers"), "segment")
