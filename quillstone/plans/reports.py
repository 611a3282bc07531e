"""Report bundles (data only): each sheet is an operator's result.

``report_sheets`` names the sheets of the four reports; ``write_reports``
writes them with ``sinks.write_report``; ``report_manifest`` is the lazy
(report, sheet, rows) frame; ``executive_brief`` is the one-row brief.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import avg_exact, exact_sum, money_exact, month_start
from ..operators import analytics as A
from ..operators import quality as Q
from ..operators import trends as T
from ..operators import views as V
from .context import Ledger


def risk_tiering(led: Ledger, n: int = 200) -> DataFrame:
    """First ``n`` rows of V12, highest risk first (then customer id)."""
    order = F.when(F.col("risk_rating") == "HIGH_RISK", 0).when(F.col("risk_rating") == "ELEVATED", 1).otherwise(2)
    v12 = V.customer_risk_summary(led.customers, led.segments, led.accounts, led.tx, led.anomalies)
    return v12.orderBy(order, "customer_id").limit(n)


def register_views(spark: SparkSession, led: Ledger) -> list[str]:
    """The twelve views as names that SQL can select from in this session."""
    views = {
        "v_daily_transaction_summary": V.daily_summary(led.tx),
        "v_monthly_transaction_summary": V.monthly_summary(led.tx),
        "v_branch_performance": V.branch_performance(led.branches, led.accounts, led.tx),
        "v_customer_segment_performance": V.segment_performance(led.segments, led.customers, led.accounts, led.tx),
        "v_merchant_category_performance": V.merchant_category_performance(led.merchants, led.tx),
        "v_channel_performance": V.channel_performance(led.tx),
        "v_debit_credit_summary": V.debit_credit_summary(led.accounts, led.customers, led.tx),
        "v_active_accounts_summary": V.active_accounts_summary(led.accounts),
        "v_top_customers": V.top_customers(led.customers, led.segments, led.accounts, led.tx),
        "v_failed_transactions_summary": V.failed_transactions_summary(led.tx),
        "v_anomaly_summary": V.anomaly_summary(led.anomalies),
        "v_customer_risk_summary": V.customer_risk_summary(led.customers, led.segments, led.accounts, led.tx, led.anomalies),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return list(views)


def report_sheets(led: Ledger) -> dict[str, dict[str, DataFrame]]:
    return {
        "report_monthly": {
            "Monthly Summary": V.monthly_summary(led.tx),
            "Channel Breakdown": V.channel_performance(led.tx),
            "Branch Overview": V.branch_performance(led.branches, led.accounts, led.tx),
        },
        "report_segments": {
            "Cohort Metrics": V.segment_performance(led.segments, led.customers, led.accounts, led.tx),
            "Risk Tiering": risk_tiering(led),
        },
        "report_anomalies": {
            "Quarantined Records": led.anomalies,
            "Summary by Type": Q.breakdown(led.anomalies, by_severity=True),
        },
        "report_data_quality": {
            "Validation Runs": led.runs,
            "Category Integrity": V.merchant_category_performance(led.merchants, led.tx),
        },
    }


def report_manifest(led: Ledger) -> DataFrame:
    """(report, sheet, row_count) for every sheet, as one lazy union of counts."""
    parts = []
    for report, sheets in report_sheets(led).items():
        for sheet, df in sheets.items():
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(report).alias("report"), F.lit(sheet).alias("sheet"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_reports(spark: SparkSession, led: Ledger, out_dir: str, fmt: str = "parquet") -> DataFrame:
    from ..sinks.tables import write_report
    manifests = [write_report(spark, name, sheets, out_dir, fmt) for name, sheets in report_sheets(led).items()]
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m)
    return out


def executive_brief(spark: SparkSession, led: Ledger, rows: int = 7) -> DataFrame:
    """Latest month: total spend, average amount, latest rolling rate, spend of each segment, flagged segments
    (against the months before)."""
    monthly = A.monthly_spend_by_segment(led.fact, led.dim_customers)
    latest = monthly.agg(F.max("month")).scalar()
    total = monthly.where(F.col("month") == latest).agg(money_exact(F.sum("total_spent_exact"))).scalar()
    avg = (led.fact.where(month_start("transaction_date") == latest)
           .agg(exact_sum("transaction_amount").alias("_s"), F.count("transaction_amount").alias("_n"))
           .select(avg_exact("_s", "_n")).scalar())
    rate = A.latest_rows_rate(led.fact, rows).scalar()
    spend = (monthly.where(F.col("month") == latest)
             .select(F.concat("segment", F.lit("="), F.format_number(F.round("total_spent_exact", 2), 2)).alias("s"))
             .agg(F.concat_ws("; ", F.sort_array(F.collect_list("s")))).scalar())
    flagged = (T.spend_trend_prior(monthly).where(F.col("flag") & (F.col("month") == latest))
               .agg(F.concat_ws(",", F.sort_array(F.collect_list("segment")))).scalar())
    return spark.range(1).select(
        F.date_format(latest, "yyyy-MM").alias("latest_month"),
        F.coalesce(total, F.lit(0.0)).alias("total_spend"),
        F.coalesce(avg, F.lit(0.0)).alias("avg_transaction"),
        F.round(F.coalesce(rate, F.lit(0.0)), 2).alias("fraud_rate_percent"),
        F.coalesce(spend, F.lit("")).alias("segment_spend"),
        F.coalesce(flagged, F.lit("")).alias("flagged_segments"))
