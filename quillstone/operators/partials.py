"""V1, V2, V6, V10 and V11 kept by run (mergeable partial states).

A run's ledger is summed once to one row for each day, channel and outcome, with exact
decimal sums, and its anomalies to one row for each type and severity. A view is the merge of
the states of the runs that are live (``sinks.commits``); its cost depends on days, channels
and runs, not on transactions. A state over all runs up to a version is advanced by adding the
states of the runs published since and taking away those of the runs that they replace:
only the new runs' files are read. First and last times cannot be taken away, so anomaly
states keep one row a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import avg_money, credit_amount, day_of, debit_amount, money, succeeded
from ..sinks.commits import Commit, commits, live_runs

SUMS = ["rows", "ok_rows", "failed_rows", "value", "debit", "credit"]


def ledger_state(tx: DataFrame) -> DataFrame:
    """day, channel and SUMS of a run's ledger (map-side combined: a hot day is one row a task)."""
    ok = succeeded()
    zero = F.lit(0).cast("decimal(14,2)")
    return tx.groupBy(day_of("transaction_timestamp").alias("day"), "channel").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("ok_rows"), F.count_if(~ok).alias("failed_rows"),
        *[F.sum(F.when(ok, v).otherwise(zero)).cast("decimal(28,2)").alias(n) for n, v in (("value", F.col("amount")), ("debit", debit_amount()), ("credit", credit_amount()))])


def anomaly_state(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_type", "severity").agg(
        F.count(F.lit(1)).alias("count"), F.min("detected_at").alias("first_detected"), F.max("detected_at").alias("last_detected"))


def merged(states: list[tuple[DataFrame, int]]) -> DataFrame:
    """The sum of states of one shape, each times its weight (-1 takes a run away); days without rows go."""
    out = None
    for state, weight in states:
        part = state.select("day", "channel", *[(F.col(c) * weight).cast(state.schema[c].dataType).alias(c) for c in SUMS])
        out = part if out is None else out.unionByName(part)
    types = {f.name: f.dataType for f in out.schema}
    return out.groupBy("day", "channel").agg(*[F.sum(c).cast(types[c]).alias(c) for c in SUMS]).where(F.col("rows") > 0)


def _state_path(run: Commit) -> str:
    return f"{run.path}/state"


def keep_state(spark: SparkSession, run: Commit) -> None:
    """Write the states of a published run next to its tables (the only read of them)."""
    ledger_state(run.read(spark, "core/transactions")).write.mode("overwrite").parquet(f"{_state_path(run)}/ledger")
    anomaly_state(run.read(spark, "dq/anomalies")).write.mode("overwrite").parquet(f"{_state_path(run)}/anomalies")


def state_at(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The merged ledger state of all runs live at a version."""
    live = live_runs(commits(spark, root), version)
    return merged([(spark.read.parquet(f"{_state_path(r)}/ledger"), 1) for r in live.values()])


def advanced(spark: SparkSession, root: str, state: DataFrame, version: int) -> DataFrame:
    """A merged state of ``version`` brought up to the newest one: new runs added, replaced ones taken away."""
    log = commits(spark, root)
    before, now = live_runs(log, version), live_runs(log)
    changes = [(state, 1)]
    for run_id, run in now.items():
        old = before.get(run_id)
        if old != run:
            changes.append((spark.read.parquet(f"{_state_path(run)}/ledger"), 1))
            if old:
                changes.append((spark.read.parquet(f"{_state_path(old)}/ledger"), -1))
    return merged(changes)


# ---------------------------------------------------------------- views from a state

def daily_summary(state: DataFrame) -> DataFrame:
    """V1."""
    per = state.groupBy(F.col("day").alias("transaction_date")).agg(*[F.sum(c).alias(c) for c in SUMS]).where(F.col("ok_rows") > 0)
    return per.select("transaction_date", F.col("ok_rows").alias("transaction_count"), money("debit").alias("total_debit"),
                      money("credit").alias("total_credit"), avg_money("value", "ok_rows").alias("avg_transaction_amount")).orderBy(F.desc("transaction_date"))


def monthly_summary(state: DataFrame) -> DataFrame:
    """V2."""
    per = state.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(*[F.sum(c).alias(c) for c in SUMS]).where(F.col("ok_rows") > 0)
    return per.select("month", F.col("ok_rows").alias("transaction_count"), money("value").alias("total_value"), money("debit").alias("total_debit"),
                      money("credit").alias("total_credit"), avg_money("value", "ok_rows").alias("avg_transaction")).orderBy("month")


def channel_performance(state: DataFrame) -> DataFrame:
    """V6."""
    per = state.groupBy("channel").agg(*[F.sum(c).alias(c) for c in SUMS]).where(F.col("ok_rows") > 0)
    share = F.round(F.lit(100.0) * F.col("ok_rows") / F.sum("ok_rows").over(Window.partitionBy()), 2)  # a row a channel
    return per.select("channel", F.col("ok_rows").alias("transaction_count"), money("value").alias("transaction_value"),
                      avg_money("value", "ok_rows").alias("avg_amount"), share.alias("volume_pct")).orderBy(F.desc("transaction_count"), "channel")


def failed_transactions_summary(state: DataFrame) -> DataFrame:
    """V10."""
    return state.where(F.col("failed_rows") > 0).select(
        F.col("day").alias("transaction_date"), "channel", F.col("failed_rows").alias("failure_count"), F.col("rows").alias("total_count"),
        F.round(F.lit(100.0) * F.col("failed_rows") / F.col("rows"), 2).alias("failure_rate")).orderBy(F.desc("failure_count"), "transaction_date", "channel")


def anomaly_summary(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """V11, from the live runs' states (a few rows a run)."""
    live = live_runs(commits(spark, root), version)
    out = None
    for run in live.values():
        part = spark.read.parquet(f"{_state_path(run)}/anomalies")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("anomaly_type", "severity").agg(
        F.sum("count").alias("count"), F.min("first_detected").alias("first_detected"), F.max("last_detected").alias("last_detected")
    ).orderBy(F.desc("count"), "anomaly_type")
