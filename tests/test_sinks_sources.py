"""Sources and sinks: write, read back, compare."""

import csv
import glob
import os
import tempfile

from pyspark.sql import functions as F

from quillstone.plans.context import Ledger
from quillstone.plans.reports import write_reports
from quillstone.schemas import BRANCHES, TRANSACTIONS
from quillstone.sinks import tables as S
from quillstone.sources import tables as R

SF = "/root/testdata/sf0.001"


def _tmp():
    return tempfile.mkdtemp(prefix="quillstone-test-")


def test_append_and_replace(spark):
    root = _tmp()
    led = Ledger(spark, SF)
    S.write_table(led.branches, root, "core", "branches", mode="overwrite")
    S.write_table(led.branches, root, "core", "branches", mode="append")
    assert R.read_table(spark, root, "core", "branches").count() == 50
    S.write_table(led.branches, root, "core", "branches", mode="overwrite")
    back = R.read_table(spark, root, "core", "branches", columns=["branch_id", "region"])
    assert back.count() == 25 and back.columns == ["branch_id", "region"]


def test_missing_table_is_empty_with_schema(spark):
    root = _tmp()
    df = R.read_table(spark, root, "core", "branches", missing_ok=True)
    assert df.count() == 0 and df.schema == BRANCHES
    assert not R.table_exists(spark, root, "core", "branches")


def test_publish_run_pointer(spark):
    root = _tmp()
    led = Ledger(spark, SF)
    res = S.RunResult(led.tx, led.anomalies, led.runs)
    S.publish_run(spark, res, root, run_id=1)
    S.publish_run(spark, res, root, run_id=2)
    cur = S.current_run_path(spark, root)
    assert cur.endswith("run_id=2")
    ledger = spark.read.parquet(f"{cur}/core/transactions")
    assert ledger.count() == led.tx.count()
    assert spark.read.parquet(f"{root}/dq/validation_runs").count() == 2


def test_export_csv_quotes(spark):
    out = os.path.join(_tmp(), "x")
    df = spark.createDataFrame([("a,b", 'say "hi"', 1)], "p string, q string, n int")
    S.export_csv(df, out, single_file=True)
    files = glob.glob(f"{out}/*.csv")
    with open(files[0], newline="") as fh:
        rows = list(csv.reader(fh))
    assert rows == [["p", "q", "n"], ["a,b", 'say "hi"', "1"]]
    back = R.read_csv(spark, out, schema=df.schema)
    assert back.collect() == df.collect()


def test_reports_and_pending_sheet(spark):
    led = Ledger(spark, SF)
    manifest = {(r.report, r.sheet): r.row_count for r in write_reports(spark, led, _tmp()).collect()}
    assert manifest[("report_anomalies", "Summary by Type")] == 6
    assert manifest[("report_segments", "Risk Tiering")] <= 200
    pending = S.write_report(spark, "empty", {"Monthly Summary": None}, _tmp()).collect()
    assert pending[0].row_count == 1


def test_typed_raw_counts_malformed(spark):
    df = spark.createDataFrame([("1", "12.50", "x", "SUCCESS"), ("2", "abc", None, None)],
                               "transaction_id string, amount string, login_attempts string, status string")
    typed = R.to_raw_schema(df, TRANSACTIONS, defaults={"status": "SUCCESS"})
    rows = typed.orderBy("transaction_id").collect()
    assert rows[0].amount is not None and rows[1].amount is None and rows[1].status == "SUCCESS"
    bad = {r.column_name: r.malformed_rows for r in R.malformed_counts(typed).collect()}
    assert bad == {"login_attempts": 1, "amount": 1}
    assert typed.schema["transaction_timestamp"].dataType == TRANSACTIONS["transaction_timestamp"].dataType


def test_ledger_written_by_month(spark):
    root = _tmp()
    led = Ledger(spark, SF)
    S.write_ledger(led.tx, root)
    back = spark.read.parquet(f"{root}/core/transactions")
    assert back.count() == led.tx.count()
    plan = back.where(F.col("month") == "1996-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_run_ledger_publishes_one_consistent_run(spark):
    import datetime as dt
    from quillstone.plans.ledger_run import run_ledger
    root = _tmp()
    led = Ledger(spark, SF)
    rec = run_ledger(spark, led.raw, led.accounts, led.customers, root, run_id=7, now=dt.datetime(2024, 1, 1))
    assert (rec["source_record_count"], rec["valid_record_count"], rec["anomaly_count"]) == (1508, 1476, 32)
    assert rec["breakdown"]["DUPLICATE"] == 8
    cur = S.current_run_path(spark, root)
    assert spark.read.parquet(f"{cur}/core/transactions").count() == 1476
    assert spark.read.parquet(f"{cur}/dq/anomalies").count() == 32
    assert spark.read.parquet(f"{root}/analytics/customer_segments").count() == 150
