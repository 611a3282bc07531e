"""Constraint checks (C1-C6). Each returns violating rows or one row of counts.

Spark enforces no keys; these replace the DDL constraints of the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count (partial aggregation map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its null count (one aggregate, then unpivot)."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return agg.unpivot([], columns, "column_name", "null_count")


def check_foreign_key(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null key has no parent (left anti join)."""
    pk = parent_key or key
    parents = parent.select(F.col(pk).alias(key)).distinct() if pk != key else parent.select(key)
    return child.where(F.col(key).isNotNull()).join(parents, key, "left_anti")


def check_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """C4: rows whose value is outside the allowed set (nulls included)."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def domain_profile(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """C4: number of distinct values, how many are outside the set, and rows outside it."""
    inside = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.agg(F.count_distinct(column).alias("distinct_values"),
                  F.count_distinct(F.when(~inside, F.col(column))).alias("distinct_outside"),
                  F.count_if(~inside).alias("rows_outside"))


def check_range(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per named rule the number of rows violating it (the rule is the valid condition)."""
    agg = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()])
    return agg.unpivot([], list(rules), "rule", "violations")


def check_unassigned(customers: DataFrame, segments: DataFrame) -> DataFrame:
    """Customers without a segment."""
    seg = segments.where(F.col("segment").isNotNull()).select("customer_id")
    return customers.join(seg, "customer_id", "left_anti")
