"""One full ledger run: rules -> clean ledger + anomalies + run record (published
together) -> segments -> reports.

The tagged frame is written once below the run directory and read back, so
the three outputs and the run metrics come from one evaluation of the rules
(no recomputation, lineage cut, nothing kept only in executor memory).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT_RULES, RuleConfig
from ..operators import quality as Q
from ..operators.segments import segment_customers
from ..sinks.tables import RunResult, publish_run, write_table


def run_ledger(spark: SparkSession, raw: DataFrame, accounts: DataFrame, customers: DataFrame, root: str,
               run_id: int, cfg: RuleConfig = DEFAULT_RULES, ids_unique: bool = False,
               now: _dt.datetime | None = None) -> dict:
    """Returns the run record as a dict (None values when the raw table is empty)."""
    started = now or _dt.datetime.now().replace(microsecond=0)
    base = f"{root.rstrip('/')}/runs/run_id={run_id}"

    def work(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/_work/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/_work/{name}")

    def marks(name: str, df: DataFrame) -> DataFrame:
        return Q.broadcast_few(work(name, df))

    tagged = work("tagged", Q.tag_first_match(raw, accounts, customers, cfg, keep=marks))
    ledger = Q.clean(tagged, ids_unique=ids_unique, keep=marks)
    anomalies = Q.anomalies(tagged, started)
    completed = _dt.datetime.now().replace(microsecond=0) if now is None else now
    record = Q.run_metrics(tagged, ledger, started, completed, run_id)
    rec = record.first()
    if rec is None:  # empty source: no run is logged
        return {}
    publish_run(spark, RunResult(ledger, anomalies, record), root, run_id)
    write_table(segment_customers(customers, started), root, "analytics", "customer_segments", mode="overwrite")
    out = rec.asDict()
    out["breakdown"] = {r["anomaly_type"]: r["count"] for r in Q.breakdown(anomalies).collect()}
    return out
