"""Sinks (SNK1-SNK6).

``publish_run`` replaces the one database transaction of the original
(clean rows + anomalies + run record together): the three tables are written
under ``<root>/runs/run_id=<id>/`` and a small ``_CURRENT`` pointer is
written last. Readers resolve the pointer, so they see either the previous
complete run or the new complete run, never a mix. A failed or retried job
leaves an unreferenced run directory behind, which is harmless.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PENDING_STATUS
from ..sources.tables import table_path


def write_table(df: DataFrame, root: str, layer: str, name: str, mode: str = "append",
                partition_by: list[str] | None = None) -> str:
    """SNK1 / SNK2: append or full replace of a Parquet table."""
    path = table_path(root, layer, name)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_ledger(tx: DataFrame, root: str, layer: str = "core", name: str = "transactions",
                 mode: str = "overwrite", files_per_month: int = 64) -> str:
    """The clean ledger, partitioned by month and sorted by account within files,
    so month filters prune directories and the ordered rules read sorted runs.

    A month is dealt into ``files_per_month`` parts by account and day, so neither a
    month nor a busy account is one task; choose it by the size of a month.
    """
    slot = F.pmod(F.xxhash64("account_id", F.to_date("transaction_timestamp")), F.lit(files_per_month))
    out = tx.withColumn("month", F.date_format("transaction_timestamp", "yyyy-MM"))
    out = out.repartition(F.col("month"), slot).sortWithinPartitions("month", "account_id", "transaction_timestamp")
    return write_table(out, root, layer, name, mode, partition_by=["month"])


def _jvm_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def _write_small_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a tiny file through the Hadoop file system (works for any cluster FS)."""
    fs, p = _jvm_fs(spark, path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    tmp = hadoop.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    # one rename over the old file: a reader finds the old text or the new one, never none
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(p), how)


def _read_small_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _jvm_fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    reader = spark.sparkContext._jvm.java.io.BufferedReader(
        spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    lines = []
    line = reader.readLine()
    while line is not None:
        lines.append(line)
        line = reader.readLine()
    reader.close()
    return "\n".join(lines)


@dataclass
class RunResult:
    ledger: DataFrame
    anomalies: DataFrame
    run_record: DataFrame


def publish_run(spark: SparkSession, result: RunResult, root: str, run_id: int) -> str:
    """SNK3 / SNK4: write the run's tables, flip the ``_CURRENT`` pointer, then log the run.

    The log has one folder for each run and is written after the flip: only published
    runs are logged, and a retry of a run replaces its record.
    """
    base = f"{root.rstrip('/')}/runs/run_id={run_id}"
    write_ledger(result.ledger, base, "core", "transactions", mode="overwrite")
    result.anomalies.write.mode("overwrite").parquet(f"{base}/dq/anomalies")
    result.run_record.write.mode("overwrite").parquet(f"{base}/dq/validation_run")
    _write_small_text(spark, f"{root.rstrip('/')}/_CURRENT", json.dumps({"run_id": run_id, "path": base}))
    result.run_record.drop("run_id").write.mode("overwrite").parquet(f"{root.rstrip('/')}/dq/validation_runs/run_id={run_id}")
    return base


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """SNK4: the records of all published runs."""
    log = spark.read.parquet(f"{root.rstrip('/')}/dq/validation_runs")
    return log.select(F.col("run_id").cast("long").alias("run_id"), *[c for c in log.columns if c != "run_id"])


def current_run_path(spark: SparkSession, root: str) -> str | None:
    text = _read_small_text(spark, f"{root.rstrip('/')}/_CURRENT")
    return json.loads(text)["path"] if text else None


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """SNK5: CSV with a header and proper quoting. ``single_file`` is for small
    frames only (one page, one report sheet)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    return path


def write_report(spark: SparkSession, name: str, sheets: dict[str, DataFrame | None], out_dir: str,
                 fmt: str = "parquet") -> DataFrame:
    """SNK6: one directory per sheet plus a ``_manifest`` (sheet, rows).

    A missing sheet (``None``) becomes the one-row "Pending Data" status sheet.
    Returns the manifest.
    """
    rows = []
    base = f"{out_dir.rstrip('/')}/{name}"
    for sheet, df in sheets.items():
        if df is None:
            df = spark.createDataFrame([(PENDING_STATUS,)], "status string")
        path = f"{base}/{sheet.replace(' ', '_')}"
        if fmt == "csv":
            export_csv(df, path, single_file=False)
        else:
            df.write.mode("overwrite").parquet(path)
        rows.append((name, sheet, spark.read.format(fmt).option("header", True).load(path).count()))
    manifest = spark.createDataFrame(rows, "report string, sheet string, row_count long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{base}/_manifest")
    return manifest
