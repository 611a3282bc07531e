"""The twelve analytical views (V1-V12) over the clean ledger.

Views that fan transactions out over accounts, customers and segments (V3,
V4, V7, V9, V12) never join raw transaction rows to the dimensions. The
ledger is aggregated once to account grain (``account_stats``: a partial /
final hash aggregate, skew-safe because the partial step combines map-side),
and the views join account-grain rows. The results equal the row-level joins
of the original SQL (checked against DuckDB), including its odd semantics:

* V3 ``active_accounts`` counts every account, active or not;
* V4 ``average_balance`` is the balance averaged over the transaction fan-out,
  i.e. weighted by ``greatest(n, 1)``;
* V7 ``net_flow`` is NULL for an account without successful transactions;
* V12 counts distinct ids, which equal sums of per-account counts because a
  transaction id belongs to one account (C1 checks uniqueness).

Money leaves every view as a double rounded to cents; sums are exact decimal
sums before that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RISK_ELEVATED, RISK_HIGH, RISK_STANDARD
from ..functions.columns import (
    avg_money, credit_amount, day_of, debit_amount, money, month_label, net_amount, succeeded,
)


def _avg(total: str, n: str):
    """sum / count in cents, exact half-up (null when there are no rows)."""
    return avg_money(total, n)


def account_stats(tx: DataFrame) -> DataFrame:
    """Ledger -> one row per account (the shared pre-aggregate)."""
    ok = succeeded("status")
    amt = F.col("amount")
    return tx.groupBy("account_id").agg(
        F.count("transaction_id").alias("n_all"),
        F.count_if(F.col("status") != "SUCCESS").alias("n_failed"),
        F.count(F.when(ok, F.col("transaction_id"))).alias("n_ok"),
        F.sum(F.when(ok, amt)).alias("value_ok"),
        F.sum(F.when(ok, debit_amount())).alias("debit_ok"),
        F.sum(F.when(ok, credit_amount())).alias("credit_ok"),
        F.sum(F.when(ok, net_amount())).alias("net_ok"),
    )


# ---------------------------------------------------------------- V1 / V2

def daily_summary(tx: DataFrame) -> DataFrame:
    """V1: successful transactions per calendar day, newest first."""
    return (tx.where(succeeded()).groupBy(day_of("transaction_timestamp").alias("transaction_date"))
            .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum(debit_amount()).alias("_d"),
                 F.sum(credit_amount()).alias("_c"), F.sum("amount").alias("_v"))
            .select("transaction_date", "transaction_count", money("_d").alias("total_debit"),
                    money("_c").alias("total_credit"),
                    _avg("_v", "transaction_count").alias("avg_transaction_amount"))
            .orderBy(F.desc("transaction_date")))


def monthly_summary(tx: DataFrame) -> DataFrame:
    """V2: successful transactions per 'yyyy-MM'."""
    return (tx.where(succeeded()).groupBy(month_label("transaction_timestamp").alias("month"))
            .agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("_v"),
                 F.sum(debit_amount()).alias("_d"), F.sum(credit_amount()).alias("_c"))
            .select("month", "transaction_count", money("_v").alias("total_value"),
                    money("_d").alias("total_debit"), money("_c").alias("total_credit"),
                    _avg("_v", "transaction_count").alias("avg_transaction"))
            .orderBy("month"))


# ---------------------------------------------------------------- V1-V6 together

#: The groupings of V1 to V4 and V6, months by channel, and the total.
SETS = [["day"], ["month"], ["branch_id"], ["segment"], ["channel"], ["month", "channel"], []]


def grouped_summary(accounts: DataFrame, segments: DataFrame, tx: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """Successful volume over several groupings at once: the ledger is summed to (account, day, channel)
    first, and these rows are expanded once for all groupings, not aggregated once for each.

    ``grouping`` has a bit for each of day, month, branch_id, segment, channel (1: summed over), so that a
    null that is summed over differs from a null value.
    """
    keys = ["day", "month", "branch_id", "segment", "channel"]
    ok = succeeded()
    per = tx.where(ok).groupBy("account_id", day_of("transaction_timestamp").alias("day"), "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v"), F.sum(debit_amount()).alias("d"), F.sum(credit_amount()).alias("c"))
    placed = per.join(accounts.select("account_id", "branch_id", "customer_id"), "account_id", "left") \
        .join(segments.select("customer_id", "segment"), "customer_id", "left")
    placed = placed.withColumn("month", F.date_format("day", "yyyy-MM"))
    out = placed.groupingSets([[F.col(c) for c in s] for s in sets or SETS], *[F.col(c) for c in keys]).agg(
        F.grouping_id().cast("long").alias("grouping"), F.sum("n").alias("transaction_count"), F.sum("v").alias("_v"), F.sum("d").alias("_d"), F.sum("c").alias("_c"))
    return out.select("grouping", *keys, "transaction_count", money("_v").alias("total_value"), money("_d").alias("total_debit"),
                      money("_c").alias("total_credit"))


# ---------------------------------------------------------------- V3

def branch_performance(branches: DataFrame, accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """V3: per branch with at least one account (inner join), all accounts counted."""
    acc = accounts.select("account_id", "branch_id").join(account_stats(tx), "account_id", "left")
    per_branch = acc.groupBy("branch_id").agg(
        F.sum(F.coalesce("n_ok", F.lit(0))).alias("transaction_count"),
        F.sum("value_ok").alias("_v"),
        F.count_distinct("account_id").alias("active_accounts"))
    return (branches.select("branch_id", "branch_name", "region", "city")
            .join(per_branch, "branch_id", "inner")
            .select("branch_id", "branch_name", "region", "city", "transaction_count",
                    money(F.coalesce("_v", F.lit(0))).alias("transaction_value"), "active_accounts")
            .orderBy(F.desc("transaction_value"), "branch_id"))


# ---------------------------------------------------------------- V4

def customer_stats(customers: DataFrame, accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """Account grain -> customer grain, for customers with at least one account."""
    acc = accounts.select("account_id", "customer_id", "current_balance").join(
        account_stats(tx), "account_id", "left")
    w = F.greatest(F.coalesce("n_ok", F.lit(0)), F.lit(1))
    bal = F.col("current_balance")
    per_customer = acc.groupBy("customer_id").agg(
        F.sum(F.coalesce("n_ok", F.lit(0))).alias("n_ok"),
        F.sum("value_ok").alias("value_ok"),
        F.sum(F.coalesce("n_all", F.lit(0))).alias("n_all"),
        F.sum(F.coalesce("n_failed", F.lit(0))).alias("n_failed"),
        F.sum(bal * w).alias("bal_w"),
        F.sum(F.when(bal.isNotNull(), w)).alias("w"),
    )
    return customers.select("customer_id").join(per_customer, "customer_id", "inner")


def segment_performance(segments: DataFrame, customers: DataFrame, accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """V4: per segment; customers without an account do not count."""
    per_c = customer_stats(customers, accounts, tx).join(segments.select("customer_id", "segment"), "customer_id")
    agg = per_c.groupBy("segment").agg(
        F.count_distinct("customer_id").alias("customers"),
        F.sum("n_ok").alias("transactions"),
        F.sum("value_ok").alias("_v"),
        F.sum("bal_w").alias("_bw"), F.sum("w").alias("_w"))
    return agg.select(
        "segment", "customers", F.col("transactions").cast("long").alias("transactions"),
        money(F.coalesce("_v", F.lit(0))).alias("total_value"),
        F.coalesce(_avg("_bw", "_w"), F.lit(0.0)).alias("average_balance"),
        F.coalesce(_avg("_v", "transactions"), F.lit(0.0)).alias("avg_transaction_amount"),
    ).orderBy(F.desc("total_value"), "segment")


# ---------------------------------------------------------------- V5 / V6

def merchant_category_performance(merchants: DataFrame, tx: DataFrame) -> DataFrame:
    """V5: every category, 0 when it has no successful transaction."""
    per_m = (tx.where(succeeded()).groupBy("merchant_id")
             .agg(F.count("transaction_id").alias("n"), F.sum("amount").alias("v")))
    agg = (merchants.select("merchant_id", "merchant_category").join(per_m, "merchant_id", "left")
           .groupBy("merchant_category").agg(F.sum(F.coalesce("n", F.lit(0))).alias("transactions"),
                                             F.sum("v").alias("_v")))
    return agg.select(
        "merchant_category", F.col("transactions").cast("long").alias("transactions"),
        money(F.coalesce("_v", F.lit(0))).alias("transaction_value"),
        F.coalesce(_avg("_v", "transactions"), F.lit(0.0)).alias("avg_amount"),
    ).orderBy(F.desc("transaction_value"), "merchant_category")


def channel_performance(tx: DataFrame) -> DataFrame:
    """V6: share of volume over the few channel rows (global window after the group-by)."""
    per = tx.where(succeeded()).groupBy("channel").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("_v"))
    share = F.round(F.lit(100.0) * F.col("transaction_count") / F.sum("transaction_count").over(Window.partitionBy()), 2)
    return per.select("channel", "transaction_count", money("_v").alias("transaction_value"),
                      _avg("_v", "transaction_count").alias("avg_amount"),
                      share.alias("volume_pct")).orderBy(F.desc("transaction_count"), "channel")


# ---------------------------------------------------------------- V7 / V8

def debit_credit_summary(accounts: DataFrame, customers: DataFrame, tx: DataFrame) -> DataFrame:
    """V7: per account with a known customer."""
    acc = accounts.select("account_id", "customer_id").join(
        customers.select("customer_id", "customer_name"), "customer_id", "inner")
    return acc.join(account_stats(tx), "account_id", "left").select(
        "account_id", "customer_name",
        money(F.coalesce("debit_ok", F.lit(0))).alias("total_debit"),
        money(F.coalesce("credit_ok", F.lit(0))).alias("total_credit"),
        money("net_ok").alias("net_flow"))


def active_accounts_summary(accounts: DataFrame) -> DataFrame:
    """V8: per account type; a null status counts in neither column."""
    return accounts.groupBy("account_type").agg(
        F.count_if(F.col("account_status") == "ACTIVE").alias("active_accounts"),
        F.count_if(F.col("account_status") != "ACTIVE").alias("inactive_accounts"),
        F.sum("current_balance").alias("_s"), F.count("current_balance").alias("_n"),
    ).select("account_type", "active_accounts", "inactive_accounts",
             _avg("_s", "_n").alias("average_balance"), money("_s").alias("total_liquidity"))


# ---------------------------------------------------------------- V9

def top_customers(customers: DataFrame, segments: DataFrame, accounts: DataFrame, tx: DataFrame,
                  n: int = 100) -> DataFrame:
    """V9: top ``n`` customers by successful value (ties: customer id). Top-k, not a sort."""
    per_c = customer_stats(customers, accounts, tx).where(F.col("n_ok") > 0)
    rows = (per_c.join(customers.select("customer_id", "customer_name"), "customer_id")
            .join(segments.select("customer_id", "segment"), "customer_id"))
    return rows.select(
        "customer_id", "customer_name", "segment",
        F.col("n_ok").cast("long").alias("transaction_count"),
        money("value_ok").alias("total_value"),
        _avg("value_ok", "n_ok").alias("average_transaction"),
        F.col("value_ok").alias("_exact"),
    ).orderBy(F.desc("_exact"), "customer_id").limit(n).drop("_exact")


# ---------------------------------------------------------------- V10 / V11

def failed_transactions_summary(tx: DataFrame) -> DataFrame:
    """Per (day, channel) with at least one failure."""
    failed = F.count_if(F.col("status") != "SUCCESS")
    agg = tx.groupBy(day_of("transaction_timestamp").alias("transaction_date"), "channel").agg(
        failed.alias("failure_count"), F.count(F.lit(1)).alias("total_count"))
    return (agg.where(F.col("failure_count") > 0)
            .withColumn("failure_rate", F.round(F.lit(100.0) * F.col("failure_count") / F.col("total_count"), 2))
            .orderBy(F.desc("failure_count"), "transaction_date", "channel"))


def anomaly_summary(anomalies_df: DataFrame) -> DataFrame:
    """V11."""
    return anomalies_df.groupBy("anomaly_type", "severity").agg(
        F.count(F.lit(1)).alias("count"), F.min("detected_at").alias("first_detected"),
        F.max("detected_at").alias("last_detected")).orderBy(F.desc("count"), "anomaly_type")


# ---------------------------------------------------------------- V12

def customer_risk_summary(customers: DataFrame, segments: DataFrame, accounts: DataFrame, tx: DataFrame,
                          anomalies_df: DataFrame) -> DataFrame:
    """Every customer. Anomalies reach a customer through its accounts only; each row is one."""
    anom_per_acc = anomalies_df.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_anom"))
    acc = (accounts.select("account_id", "customer_id")
           .join(account_stats(tx).select("account_id", "n_all", "n_failed"), "account_id", "left")
           .join(anom_per_acc, "account_id", "left"))
    per_c = acc.groupBy("customer_id").agg(
        F.sum(F.coalesce("n_all", F.lit(0))).alias("total_transactions"),
        F.sum(F.coalesce("n_anom", F.lit(0))).alias("anomaly_count"),
        F.sum(F.coalesce("n_failed", F.lit(0))).alias("failed_transactions"))
    rows = (customers.select("customer_id", "customer_name")
            .join(segments.select("customer_id", "segment"), "customer_id", "left")
            .join(per_c, "customer_id", "left"))
    n_anom = F.coalesce("anomaly_count", F.lit(0)).cast("long")
    n_fail = F.coalesce("failed_transactions", F.lit(0)).cast("long")
    return rows.select(
        "customer_id", "customer_name", "segment",
        F.coalesce("total_transactions", F.lit(0)).cast("long").alias("total_transactions"),
        n_anom.alias("anomaly_count"), n_fail.alias("failed_transactions"),
        F.when(n_anom > 0, RISK_HIGH).when(n_fail > 2, RISK_ELEVATED).otherwise(RISK_STANDARD).alias("risk_rating"))
