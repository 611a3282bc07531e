"""Commits with conflict detection, pinned readers, and views kept by run."""

import os
import threading

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from quillstone.operators import partials as P
from quillstone.operators import views as V
from quillstone.plans.context import Ledger
from quillstone.session import scratch_path
from quillstone.sinks import commits as C
from quillstone.sinks.tables import RunResult


@pytest.fixture(scope="module")
def led(spark):
    found = Ledger(spark, SF_SMALL, materialize=True)
    found.tagged  # noqa: B018  (written once)
    return found


def result(led, run_id, third):
    tx = led.tx.where(F.pmod("transaction_id", F.lit(3)) == third).where("transaction_timestamp >= '1997-06-01'")
    found = led.anomalies.where(F.pmod("transaction_id", F.lit(3)) == third)
    return RunResult(tx, found, led.runs.withColumn("run_id", F.lit(run_id).cast("long")))


def put(spark, led, root, run_id, third, **more):
    return C.publish(spark, result(led, run_id, third), root, run_id, files_per_month=1, **more)


def test_an_entry_is_put_once(spark):
    path = f"{scratch_path(spark, 'test-put')}/x/1.json"
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((C.put_if_absent(spark, path, f"t{i}"), i))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(ok for ok, _ in won) == 1
    assert C._read_small_text(spark, path) == f"t{next(i for ok, i in won if ok)}"


def test_concurrent_publishers_lose_nothing(spark, led):
    """Two publishers of different runs at once: both are in the log, in order; of two of one run, one conflicts."""
    root = scratch_path(spark, "test-publishers")
    done, failed = [], []

    def work(run_id, third):
        try:
            done.append(put(spark, led, root, run_id, third))
        except C.RunConflict as e:
            failed.append(str(e))

    threads = [threading.Thread(target=work, args=a) for a in ((1, 0), (2, 1), (7, 2), (7, 2))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = C.commits(spark, root)
    assert [c.version for c in log] == [1, 2, 3] and sorted(c.run_id for c in log) == [1, 2, 7]
    assert len(done) == 3 and len(failed) == 1
    assert C.run_log(spark, root).count() == 3
    assert C.read_runs(spark, root, "dq/anomalies").count() == led.anomalies.count()
    local = root.removeprefix("file:")
    assert not [f for f in os.listdir(f"{local}/_commits") if f.endswith(".draft")]


def test_readers_pin_a_version(spark, led):
    root = scratch_path(spark, "test-pinned")
    assert C.read_runs(spark, root, "dq/anomalies") is None
    put(spark, led, root, 1, 0)
    pinned = C.read_runs(spark, root, "core/transactions", version=1)
    before = pinned.count()
    with pytest.raises(C.RunConflict):
        put(spark, led, root, 1, 1)
    replaced = put(spark, led, root, 1, 1, replace=True)
    assert (replaced.version, replaced.replaces) == (2, 1)
    put(spark, led, root, 2, 2)
    assert pinned.count() == before == C.read_runs(spark, root, "core/transactions", version=1).count()
    now = C.read_runs(spark, root, "core/transactions")
    ids = {r[0] for r in now.select(F.pmod("transaction_id", F.lit(3))).distinct().collect()}
    assert ids == {1, 2} and C.run_log(spark, root).count() == 2


def test_an_empty_run_can_be_read(spark, led):
    root = scratch_path(spark, "test-empty")
    C.publish(spark, RunResult(led.tx.limit(0), led.anomalies.limit(0), led.runs), root, 1)
    ledger = C.read_runs(spark, root, "core/transactions")
    assert ledger.count() == 0 and ledger.columns == led.tx.columns and C.run_log(spark, root).count() == 1


def test_a_failed_publisher_leaves_the_log_alone(spark, led):
    root = scratch_path(spark, "test-failed")
    put(spark, led, root, 1, 0)
    broken = RunResult(led.tx.limit(5), led.anomalies.limit(1).withColumn("x", F.raise_error(F.lit("lost"))), led.runs)
    with pytest.raises(Exception, match="lost"):
        C.publish(spark, broken, root, 2, files_per_month=1)
    assert [c.run_id for c in C.commits(spark, root)] == [1]
    put(spark, led, root, 2, 1)
    assert [c.run_id for c in C.commits(spark, root)] == [1, 2]


def rows(df):
    return sorted(map(str, df.collect()))


def test_views_by_run_equal_a_recomputation(spark, led):
    """Three runs, one of them replaced: the advanced state's views equal those over all live rows, and only a new run's ledger is read."""
    root = scratch_path(spark, "test-partials")
    state, version, read = None, 0, []
    for run_id, third, replace in ((1, 0, False), (2, 0, False), (3, 2, False), (2, 1, True)):
        done = put(spark, led, root, run_id, third, replace=replace)
        P.keep_state(spark, done)
        before = state
        state = P.state_at(spark, root) if state is None else P.advanced(spark, root, state, version)
        if before is not None:
            read.append([f for f in state.inputFiles() if "/merged-" not in f])
        state.write.parquet(f"{root}/merged-{done.version}")
        state, version = spark.read.parquet(f"{root}/merged-{done.version}"), done.version
    tx, found = (C.read_runs(spark, root, t) for t in ("core/transactions", "dq/anomalies"))
    assert rows(P.daily_summary(state)) == rows(V.daily_summary(tx))
    assert rows(P.monthly_summary(state)) == rows(V.monthly_summary(tx))
    assert rows(P.channel_performance(state)) == rows(V.channel_performance(tx))
    assert rows(P.failed_transactions_summary(state)) == rows(V.failed_transactions_summary(tx))
    assert rows(P.anomaly_summary(spark, root)) == rows(V.anomaly_summary(found))
    assert rows(P.state_at(spark, root)) == rows(state)
    assert all("/state/ledger" in f for files in read for f in files)  # no transactions
    assert {f.split("run_id=")[1].split("/")[0] for f in read[0]} == {"2"} and {f.split("run_id=")[1].split("/")[0] for f in read[2]} == {"2"}
