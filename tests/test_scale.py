"""Hot keys, ties, retries and complete streams."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillstone.operators import analytics as A
from quillstone.operators import cleaning as K
from quillstone.operators import joins as J
from quillstone.operators import quality as Q
from quillstone.plans.context import Ledger, session_ledger
from quillstone.plans.reports import register_views
from quillstone.sinks import tables as S
from quillstone.session import ensure_checkpoint_dir, scratch_path
from tests.conftest import ROOT, SF_SMALL


@pytest.mark.parametrize("values", [
    [1.0] * 980 + [2.0] * 20, [i % 11 / 10 for i in range(3000)], [float(i * i % 977) - 300 for i in range(1501)],
    [1e300, -1e300, 5e-324, 0.0, 1.0, float("nan"), None], [7.0], [1.7976931348623157e308, -1.7976931348623157e308],
])
def test_quantiles_with_ties_and_extremes(spark, values):
    import pandas as pd
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = K.exact_quantiles(df, ["x"], probs, bins=8)["x"]
    known = sorted(v for v in values if v is not None and v == v)
    for p, g in zip(probs, got):
        at = p * (len(known) - 1)
        low, high = known[int(at)], known[min(int(at) + 1, len(known) - 1)]
        want = low * (1 - (at - int(at))) + high * (at - int(at)) if high != low else low
        assert g == pytest.approx(want, rel=1e-9, abs=1e-12)
    if all(abs(v) < 1e100 for v in known):
        assert got == pytest.approx(pd.Series(known).quantile(probs).tolist())


def test_quantiles_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert K.exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.0]}
    assert K.exact_quantiles(df.where("y > 1"), ["y"], [0.5]) == {"y": [None]}


def test_statistics_hold_no_list_of_values():
    assert "collect_list" not in open(K.__file__, encoding="utf-8").read()


def test_clipping_changes_planted_outliers(spark):
    led = session_ledger(spark, SF_SMALL)
    clipped = K.clip_iqr(led.cleaning_input, ["l_quantity", "l_extendedprice"])
    before, after = (d.agg(F.max("l_quantity"), F.max("l_extendedprice")).first() for d in (led.cleaning_input, clipped))
    assert after[0] < before[0] and after[1] < before[1]


def test_left_join_with_a_hot_right_key(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k long, l string")
    right = spark.range(2000).selectExpr("1L k", "id r").unionByName(spark.createDataFrame([(2, None), (None, 5)], "k long, r long"))
    got = J.left_join_where(left, right, "k", F.col("r") >= 1990)
    want = left.join(right.where("r >= 1990"), "k", "left")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_spend_is_summed_before_the_join(spark):
    led = session_ledger(spark, SF_SMALL)
    for frame in (A.monthly_spend_by_segment(led.fact, led.dim_customers), A.segment_overview(led.fact, led.dim_customers)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        join, aggregate = plan.index("Join Inner"), plan.rindex("Aggregate [customer_id")
        assert aggregate > join  # below it in the tree


def test_a_month_of_the_ledger_is_many_tasks(spark):
    rows = spark.range(4000).selectExpr(
        "id transaction_id", "if(id % 3 = 0, 1L, id) account_id", "timestamp_ntz'2024-05-01 00:00:00' + make_dt_interval(int(id % 28)) transaction_timestamp")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart here
    try:
        path = S.write_ledger(rows, scratch_path(spark, "test-ledger"), files_per_month=16)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 2000 and sum(r["count"] for r in files) == 4000


def test_keyset_pages_reach_null_keys(spark):
    rows = [(str(i), "c", "m", v, None, "t", "l", "ch", 1.0, 1) for i, v in enumerate([3.0, None, 1.0, None, 2.0, None, 2.0])]
    schema = ("transaction_id string, customer_id string, merchant_id string, transaction_amount double, transaction_date timestamp_ntz, "
              "transaction_type string, location string, channel string, account_balance double, login_attempts int")
    fact = spark.createDataFrame(rows, schema)
    for direction in ("asc", "desc"):
        whole = [r.transaction_id for r in A.transaction_page(fact, per_page=100, sort_by="transaction_amount", sort_dir=direction).collect()]
        seen, after = [], None
        while True:
            page = A.transaction_page(fact, per_page=5, sort_by="transaction_amount", sort_dir=direction, after=after).collect()
            if not page:
                break
            seen += [r.transaction_id for r in page]
            after = (page[-1].transaction_amount, page[-1].transaction_id)
        assert seen == whole and len(seen) == 7


def test_repeated_ids_are_separate_anomalies(spark):
    from quillstone.operators import views as V
    led = session_ledger(spark, SF_SMALL)
    acc = led.accounts.select("account_id").first()[0]
    twice = spark.createDataFrame([(1, 5, acc), (1, 5, acc)], "anomaly_id long, transaction_id long, account_id long")
    got = V.customer_risk_summary(led.customers, led.segments, led.accounts, led.tx, twice)
    assert got.agg(F.sum("anomaly_count")).first()[0] == 2


def test_money_beyond_doubles_is_exact(spark):
    from quillstone.functions.columns import money
    big = spark.sql("select cast('90071992547409.93' as decimal(20,2)) v union all select cast('0.02' as decimal(20,2))")
    assert str(big.agg(money(F.sum("v")).alias("m")).first()["m"]).startswith("90071992547409.95")


def _record(spark, run_id, day):
    return spark.createDataFrame([(run_id, dt.datetime(2024, 1, day), 10, "SUCCESS")],
                                 "run_id long, run_started_at timestamp_ntz, source_record_count long, status string")


def test_retried_runs_are_logged_once(spark):
    led = session_ledger(spark, SF_SMALL)
    root = scratch_path(spark, "test-runs")
    for run_id, day in ((1, 1), (2, 2), (2, 2), (3, 2)):
        S.publish_run(spark, S.RunResult(led.tx.limit(5), led.anomalies.limit(5), _record(spark, run_id, day)), root, run_id)
    log = S.run_log(spark, root)
    assert sorted(r.run_id for r in log.collect()) == [1, 2, 3] and log.columns[0] == "run_id"
    assert Q.latest_run(log).first().run_id == 3
    assert S.current_run_path(spark, root).endswith("run_id=3")


def test_a_failed_publish_leaves_the_last_run(spark):
    led = session_ledger(spark, SF_SMALL)
    root = scratch_path(spark, "test-crash")
    S.publish_run(spark, S.RunResult(led.tx.limit(5), led.anomalies.limit(5), _record(spark, 1, 1)), root, 1)
    bad = led.anomalies.limit(1).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        S.publish_run(spark, S.RunResult(led.tx.limit(5), bad, _record(spark, 2, 2)), root, 2)
    assert S.current_run_path(spark, root).endswith("run_id=1")
    assert [r.run_id for r in S.run_log(spark, root).collect()] == [1]


def test_views_can_be_selected_by_name(spark):
    led = session_ledger(spark, SF_SMALL)
    names = register_views(spark, led)
    assert len(names) == 12
    for name in names:
        assert spark.sql(f"SELECT * FROM {name} LIMIT 1").columns
    total = spark.sql("SELECT sum(transaction_count) n FROM v_channel_performance").first().n
    assert total == led.tx.where("status = 'SUCCESS'").count()


def test_streams_are_complete(spark):
    """Every input row is decided, and every row is in a window."""
    from quillstone.plans.catalog import QUERIES
    n = Ledger(spark, SF_SMALL).fx.stream_input().count()
    assert QUERIES["stream_first_match"](spark, SF_SMALL).count() == n
    assert QUERIES["stream_channel_volume"](spark, SF_SMALL).agg(F.sum("transactions")).first()[0] == n


def test_late_rows_are_kept(spark):
    from quillstone.streaming.rules import read_transaction_stream, write_late_rows
    base = scratch_path(spark, "test-late")
    raw = Ledger(spark, SF_SMALL).raw.limit(1)
    for i, seconds in enumerate((0, 600, 100, 590, 700)):  # the third is 500 s behind the second
        raw.withColumns({"transaction_id": F.lit(i).cast("long"), "transaction_timestamp": F.timestamp_add(
            "SECOND", F.lit(seconds), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))}).coalesce(1).write.mode("append").parquet(f"{base}/in")
    late = write_late_rows(read_transaction_stream(spark, f"{base}/in", files_per_batch=1), f"{base}/out", f"{base}/ck", "1 minute")
    assert [r.transaction_id for r in spark.read.parquet(late).collect()] == [2]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The stateful stream runs with the repository on the driver's path only."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from quillstone.session import local_session\n"
            "spark = local_session(2, shuffle_partitions=2)\n"
            "from quillstone.plans.catalog import QUERIES\n"
            f"print('rows', QUERIES['stream_first_match'](spark, {SF_SMALL!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-2000:]
