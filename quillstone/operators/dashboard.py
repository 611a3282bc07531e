"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, avg_money, money, succeeded


def kpi_totals(tx: DataFrame, customers: DataFrame, anomalies_df: DataFrame) -> DataFrame:
    """Over the clean ledger with *all* statuses, plus customer and anomaly counts.

    The other two counts are scalar subqueries, not joins.
    """
    return tx.agg(F.count(F.lit(1)).alias("total_txns"), F.sum("amount").alias("_v"),
                  F.count("amount").alias("_n"),
                  F.count_if(F.col("status") != "SUCCESS").alias("failed_txns")).select(
        "total_txns", money(F.coalesce("_v", F.lit(0))).alias("total_val"),
        F.coalesce(avg_money("_v", "_n"), F.lit(0.0)).alias("avg_txn"),
        "failed_txns",
        customers.select(F.count(F.lit(1))).scalar().alias("active_cust"),
        anomalies_df.select(F.count(F.lit(1))).scalar().alias("anom_cnt"))


def debit_credit_split(monthly: DataFrame) -> DataFrame:
    """Whole-period debit and credit as two rows."""
    totals = monthly.agg(F.round(F.sum("total_debit"), 2).alias("Debit / Withdrawals"),
                         F.round(F.sum("total_credit"), 2).alias("Credit Deposits"))
    return totals.unpivot([], ["Debit / Withdrawals", "Credit Deposits"], "flow", "amount")


def distinct_values(tx: DataFrame, column: str) -> DataFrame:
    """D3: filter options."""
    return tx.select(column).distinct()


def top_merchant_categories(category_perf: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` categories by value."""
    return category_perf.orderBy(F.desc("transaction_value"), "merchant_category").limit(n)


def filter_transactions(tx: DataFrame, channel: str | None = None, state: str | None = None,
                        tx_type: str | None = None, limit: int = 500) -> DataFrame:
    """SUCCESS plus optional equality filters ("ALL" = none), newest first, first ``limit``."""
    preds = [succeeded()]
    for c, v in (("channel", channel), ("state", state), ("transaction_type", tx_type)):
        if v is not None and v != "ALL":
            preds.append(F.col(c) == F.lit(v))
    return (tx.where(all_of(preds))
            .orderBy(F.desc("transaction_timestamp"), "transaction_id").limit(limit))
