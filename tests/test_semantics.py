"""Semantics kept from the original views and analytics, checked on small inputs."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import analytics as A
from quillstone.operators import cleaning as K
from quillstone.operators import trends as T
from quillstone.operators import views as V
from quillstone.operators.rolling import rolling_rows
from quillstone.plans.context import Ledger
from quillstone.schemas import ACCOUNTS, BRANCHES, CUSTOMERS, TRANSACTIONS

D = Decimal


def _tx(tid, acct, amount, ttype="DEBIT", status="SUCCESS", ts=dt.datetime(2024, 1, 5)):
    return (tid, acct, None, ts, ttype, "UPI", D(amount), D("10.00"), None, "S1", status, None, None, 1)


@pytest.fixture(scope="module")
def small(spark):
    accounts = spark.createDataFrame([
        (1, 10, "SAVINGS", None, D("100.00"), 1, "ACTIVE"),
        (2, 10, "SAVINGS", None, D("300.00"), 1, "INACTIVE"),
        (3, 20, "CURRENT", None, D("50.00"), 2, None),
    ], ACCOUNTS)
    customers = spark.createDataFrame([
        (10, "Ann", None, 30, "F", None, "S1", "SALARIED", D("1.00"), None),
        (20, "Bob", None, 70, "M", None, "S2", "SALARIED", D("1.00"), None),
        (30, "Cy", None, 40, "M", None, "S3", "SALARIED", D("1.00"), None),
    ], CUSTOMERS)
    tx = spark.createDataFrame([
        _tx(1, 1, "10.00"), _tx(2, 1, "20.00", "CREDIT"), _tx(3, 1, "5.00", "TRANSFER"),
        _tx(4, 2, "7.00", status="FAILED"), _tx(5, 2, "1.00", status="FAILED"), _tx(6, 2, "1.00", status="FAILED"),
    ], TRANSACTIONS)
    branches = spark.createDataFrame([(1, "B1", "B1", "S1", "R", None), (2, "B2", "B2", "S2", "R", None),
                                      (3, "B3", "B3", "S3", "R", None)], BRANCHES)
    segments = customers.select("customer_id", F.lit("X").alias("segment"))
    return dict(accounts=accounts, customers=customers, tx=tx, branches=branches, segments=segments)


def test_v3_counts_inactive_accounts_and_drops_branch_without_accounts(small):
    rows = {r.branch_id: r for r in V.branch_performance(small["branches"], small["accounts"], small["tx"]).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].active_accounts == 2 and rows[1].transaction_count == 3 and rows[1].transaction_value == 35.0


def test_v4_balance_weighted_by_transactions(small):
    r = V.segment_performance(small["segments"], small["customers"], small["accounts"], small["tx"]).collect()[0]
    # fan-out rows: account 1 x3 successful tx, account 2 x1 (no success), account 3 x1
    assert r.average_balance == round((100 * 3 + 300 + 50) / 5, 2)
    assert r.customers == 2 and r.transactions == 3


def test_v7_null_net_flow_and_transfer(small):
    rows = {r.account_id: r for r in V.debit_credit_summary(small["accounts"], small["customers"], small["tx"]).collect()}
    assert rows[1].total_debit == 10.0 and rows[1].total_credit == 20.0 and rows[1].net_flow == 5.0
    assert rows[2].total_debit == 0.0 and rows[2].net_flow is None


def test_v8_null_status_counts_in_neither(small):
    rows = {r.account_type: r for r in V.active_accounts_summary(small["accounts"]).collect()}
    assert (rows["CURRENT"].active_accounts, rows["CURRENT"].inactive_accounts) == (0, 0)
    assert (rows["SAVINGS"].active_accounts, rows["SAVINGS"].inactive_accounts) == (1, 1)


def test_v12_unknown_account_anomalies_reach_no_customer(spark, small):
    anomalies = spark.createDataFrame([(1, 99, 77, "INVALID_ACCOUNT"), (2, 98, 1, "HIGH_AMOUNT")],
                                      "anomaly_id long, transaction_id long, account_id long, anomaly_type string")
    rows = {r.customer_id: r for r in V.customer_risk_summary(
        small["customers"], small["segments"], small["accounts"], small["tx"], anomalies).collect()}
    assert rows[10].risk_rating == "HIGH_RISK" and rows[10].anomaly_count == 1
    assert rows[10].failed_transactions == 3 and rows[10].total_transactions == 6
    assert rows[20].risk_rating == "STANDARD" and rows[30].total_transactions == 0


def test_v9_ties_at_cut_broken_by_customer_id(spark, small):
    tx = spark.createDataFrame([_tx(1, 1, "10.00"), _tx(2, 3, "10.00")], TRANSACTIONS)
    top = V.top_customers(small["customers"], small["segments"], small["accounts"], tx, n=1).collect()
    assert [r.customer_id for r in top] == [10]
    plan = V.top_customers(small["customers"], small["segments"], small["accounts"], tx, n=1) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_exact_half_cent_average_rounds_up(spark):
    from quillstone.functions.columns import avg_money
    df = spark.createDataFrame([(D("4360071.60"), 16), (D("-0.05"), 2), (D("1.00"), 0)], "s decimal(24,2), n long")
    assert [r[0] for r in df.select(avg_money("s", "n")).collect()] == [272504.48, -0.03, None]


def test_t1_bound_never_flags(spark):
    led = Ledger(spark, "/root/testdata/sf0.001")
    t = T.spend_trend(A.monthly_spend_by_segment(led.fact, led.dim_customers))
    mx = t.agg(F.max(F.abs("z_score"))).first()[0]
    assert mx <= math.sqrt(2) + 1e-9
    assert t.where("flag").count() == 0


def test_t2_single_and_constant_series(spark):
    m = spark.createDataFrame([(dt.datetime(2024, i, 1), "S", 5.0) for i in range(1, 6)],
                              "month timestamp_ntz, segment string, total_spent double")
    rows = T.spend_trend_prior(m).orderBy("month").collect()
    assert rows[0].z_score is None and all(r.z_score is None and not r.flag for r in rows)
    one = T.spend_trend(m.limit(1)).collect()[0]
    assert one.z_score == 0.0 and one.rolling_std == 2.220446049250313e-16


def test_mode_tie_lowest_and_all_null(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "x string, y string")
    out = K.impute_mode(df, ["x", "y"]).collect()
    assert [r.x for r in out] == ["b", "a", "b", "a", "a"]
    assert {r.y for r in out} == {"UNKNOWN"}


def test_exact_quantiles_match_pandas(spark):
    import numpy as np
    import pandas as pd
    vals = [float(v) for v in np.random.default_rng(7).normal(size=2001)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = K.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], bins=16)["x"]
    want = pd.Series(vals).quantile([0.25, 0.5, 0.75]).tolist()
    assert got == pytest.approx(want, rel=0, abs=1e-12)


def test_clip_keeps_every_row(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    out = [r.x for r in K.clip_iqr(df, ["x"]).collect()]
    assert len(out) == 5 and max(out) == 4 + 1.5 * 2


def test_rolling_rows_equals_global_window(spark):
    led = Ledger(spark, "/root/testdata/sf0.001")
    fact = led.fact.select("transaction_id", "transaction_date", "transaction_type")
    flag = (F.col("transaction_type") == "Credit").cast("long")
    w = Window.orderBy("transaction_date", "transaction_id").rowsBetween(-6, 0)
    want = {r[0]: (r[1], r[2]) for r in fact.select("transaction_id", F.sum(flag).over(w), F.count(F.lit(1)).over(w)).collect()}
    for parts in (1, 7, 60):
        got = rolling_rows(fact, ["transaction_date", "transaction_id"], {"credit": flag}, 6, parts)
        got = {r.transaction_id: (r._sum_credit, r._rows) for r in got.collect()}
        assert got == want


def test_page_past_the_end_and_keyset(spark):
    led = Ledger(spark, "/root/testdata/sf0.001")
    assert A.transaction_page(led.fact, page=10_000, per_page=100).count() == 0
    p1 = A.transaction_page(led.fact, page=1, per_page=10, sort_by="transaction_amount", sort_dir="desc").collect()
    p2 = A.transaction_page(led.fact, page=2, per_page=10, sort_by="transaction_amount", sort_dir="desc").collect()
    last = p1[-1]
    k2 = A.transaction_page(led.fact, per_page=10, sort_by="transaction_amount", sort_dir="desc",
                            after=(last.transaction_amount, last.transaction_id)).collect()
    assert [r.transaction_id for r in k2] == [r.transaction_id for r in p2]
    info = A.page_info(led.fact, per_page=100).first()
    assert info.total_pages == max(1, math.ceil(info.total / 100))


def test_search_is_literal(spark):
    led = Ledger(spark, "/root/testdata/sf0.001")
    from quillstone.functions.columns import text_match
    assert led.fact.where(text_match(["location"], "%")).count() == 0
    assert led.fact.where(text_match(["location"], "nation_1")).count() > 0


def test_unknown_segment_raises(spark):
    led = Ledger(spark, "/root/testdata/sf0.001")
    with pytest.raises(A.UnknownSegment):
        A.segment_history(led.fact, led.dim_customers, "Nope", require_rows=True)
