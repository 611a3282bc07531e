"""Plan-shape checks."""

import re

from quillstone.operators import analytics as A
from quillstone.operators import views as V
from quillstone.plans.context import Ledger

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a2_global_order_without_single_partition_over_rows(spark):
    led = Ledger(spark, SF)
    plan = _plan(A.rolling_rate(led.fact, 7))
    # the per-bucket window carries the rows
    assert re.search(r"windowspecdefinition\(_bucket#\d+", plan)
    # every single-partition step numbers only the bounded tail set (last 6 rows per bucket):
    # the next exchange below it is the per-bucket one, with the tail filter in between
    parts = plan.split("Exchange SinglePartition")
    assert len(parts) >= 2
    for below in parts[1:]:
        segment = below.split("Exchange hashpartitioning")[0]
        assert re.search(r"\(_rd#\d+ <= 6\)", segment), segment


def test_a4_latest_rows_are_top_k(spark):
    led = Ledger(spark, SF)
    plan = _plan(A.latest_rows_rate(led.fact, 7))
    assert "TakeOrderedAndProject" in plan
    assert "Window" not in plan


def test_v12_has_no_expand_and_no_tx_anomaly_product(spark):
    led = Ledger(spark, SF)
    plan = _plan(V.customer_risk_summary(led.customers, led.segments, led.accounts, led.tx, led.anomalies))
    assert "Expand" not in plan
    # transactions and anomalies are each aggregated to account grain before any join
    assert plan.count("partial_count") >= 2


def test_top_k_operators(spark):
    led = Ledger(spark, SF)
    for df in (V.top_customers(led.customers, led.segments, led.accounts, led.tx, 100),
               A.top_locations(led.fact, 10),
               A.transaction_page(led.fact, search="NATION_1", page=2, per_page=15, sort_by="transaction_amount")):
        assert "TakeOrderedAndProject" in _plan(df)


def test_scans_prune_columns_and_push_filters(spark):
    """Queries over the stored tables read only their columns and push filters into the scan."""
    led = Ledger(spark, SF, materialize=True)
    plan = _plan(led.raw.where("channel = 'POS'").select("transaction_id", "amount"))
    assert "EqualTo(channel,POS)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(re.findall(r"(\w+):", schema)) == ["amount", "channel", "transaction_id"]
