"""Quality rules: edge cases and randomised checks against a sequential restatement.

The restatement below walks the rows one by one in the order the rules are
specified (first match: rules 1-6 in turn over a growing set of tagged rows;
independent: each rule alone). The Spark operators compute the same with
windows over (account, time bucket) partitions; small buckets force many
rows to sit on bucket edges.
"""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstone.config import RuleConfig
from quillstone.operators import quality as Q
from quillstone.schemas import ACCOUNTS, CUSTOMERS, TRANSACTIONS

T0 = dt.datetime(2024, 3, 1, 0, 0, 0)
PHYSICAL = ("ATM", "BRANCH")


# ---------------------------------------------------------------- helpers

def _row(tid, acct, ts, amount=100, bal=1000, ttype="DEBIT", channel="UPI", state="S1"):
    return (tid, acct, None, ts, ttype, channel, Decimal(str(amount)).quantize(Decimal("0.01")),
            Decimal(str(bal)).quantize(Decimal("0.01")), None, state, "SUCCESS", None, None, 1)


def _frames(spark, rows, homes):
    raw = spark.createDataFrame(rows, TRANSACTIONS)
    acc_rows = [(a, a, "SAVINGS", None, Decimal("0.00"), 1, "ACTIVE") for a in homes]
    cust_rows = [(a, f"C{a}", None, 30, "F", None, h, "SALARIED", Decimal("0.00"), None) for a, h in homes.items()]
    return raw, spark.createDataFrame(acc_rows, ACCOUNTS), spark.createDataFrame(cust_rows, CUSTOMERS)


def _order_key(r):
    return (r[3], r[6], r[4], r[0])  # ts, amount, type, id


def first_match_reference(rows, homes, high=500000, rapid=5):
    """Sequential first-match tagging, one rule after another."""
    tags = {}
    for r in rows:
        if r[6] is not None and r[6] > high:
            tags[r[0]] = "HIGH_AMOUNT"
    for r in rows:
        if r[0] not in tags and r[1] not in homes:
            tags[r[0]] = "INVALID_ACCOUNT"
    for r in rows:
        if r[0] not in tags and r[7] is not None and r[7] < 0:
            tags[r[0]] = "NEGATIVE_BALANCE"
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[3], r[6], r[4]), []).append(r[0])
    for r in rows:
        if r[0] not in tags and len(groups[(r[1], r[3], r[6], r[4])]) > 1:
            tags[r[0]] = "DUPLICATE"
    before_rapid = set(tags)
    by_acct = {}
    for r in rows:
        if r[1] is not None:
            by_acct.setdefault(r[1], []).append(r)
    hits = []
    for acct, rs in by_acct.items():
        rs.sort(key=_order_key)
        for i in range(1, len(rs)):
            gap = (rs[i][3] - rs[i - 1][3]).total_seconds()
            if 0 < gap <= rapid and rs[i][0] not in before_rapid:
                hits.append((rs[i - 1][0], rs[i][0]))
    for prev_id, cur_id in hits:
        tags.setdefault(prev_id, "RAPID_TRANSACTIONS")
        tags.setdefault(cur_id, "RAPID_TRANSACTIONS")
    for r in rows:
        if r[0] in tags:
            continue
        home = homes.get(r[1])
        if r[5] in PHYSICAL and home and r[9] and r[9] != home:
            tags[r[0]] = "LOCATION_MISMATCH"
    return {r[0]: tags.get(r[0]) for r in rows}


def independent_reference(rows, homes, high=500000, rapid=5):
    out = []
    for r in rows:
        if r[6] is not None and r[6] > high:
            out.append((r[0], "HIGH_AMOUNT"))
        if r[1] not in homes:
            out.append((r[0], "INVALID_ACCOUNT"))
        if r[7] is not None and r[7] < 0:
            out.append((r[0], "NEGATIVE_BALANCE"))
        home = homes.get(r[1])
        if r[1] in homes and home is not None and r[9] is not None and r[9] != home and r[5] in PHYSICAL:
            out.append((r[0], "LOCATION_MISMATCH"))
    by_acct, groups = {}, {}
    for r in rows:
        by_acct.setdefault(r[1], []).append(r)
        groups.setdefault((r[1], r[3], r[6], r[4]), []).append(r[0])
    for rs in by_acct.values():
        rs.sort(key=_order_key)
        for i in range(1, len(rs)):
            if (rs[i][3] - rs[i - 1][3]).total_seconds() <= rapid:
                out.append((rs[i][0], "RAPID_TRANSACTIONS"))
    for ids in groups.values():
        for tid in sorted(ids)[1:]:
            out.append((tid, "DUPLICATE"))
    return sorted(out)


def _spark_first_match(spark, rows, homes, cfg=RuleConfig()):
    raw, acc, cust = _frames(spark, rows, homes)
    got = Q.tag_first_match(raw, acc, cust, cfg).select("transaction_id", "anomaly_type").collect()
    return {r[0]: r[1] for r in got}


def _spark_independent(spark, rows, homes, cfg=RuleConfig()):
    raw, acc, cust = _frames(spark, rows, homes)
    got = Q.independent_anomalies(raw, acc, cust, cfg).select("transaction_id", "anomaly_type").collect()
    return sorted((r[0], r[1]) for r in got)


# ---------------------------------------------------------------- edge cases

def s(n):
    return T0 + dt.timedelta(seconds=n)


EDGE_HOMES = {1: "S1", 2: "S2", 3: "S3", 4: None}
EDGE_ROWS = [
    # zero-second gap on account 1: no rapid in first-match, rapid in independent
    _row(1, 1, s(0)), _row(2, 1, s(0), amount=101),
    # gap of exactly 5 s (rapid) and just above 5 s (not)
    _row(3, 2, s(100)), _row(4, 2, s(105)), _row(5, 2, s(110.5)),
    # three-row burst
    _row(6, 3, s(200)), _row(7, 3, s(202)), _row(8, 3, s(204)),
    # duplicate pair whose twin is quarantined as HIGH_AMOUNT? no: duplicates share amount, both high
    _row(9, 1, s(300), amount=600000), _row(10, 1, s(300), amount=600000),
    # duplicate pair (both tagged DUPLICATE)
    _row(11, 2, s(400)), _row(12, 2, s(400)),
    # rapid predecessor already quarantined (negative balance)
    _row(13, 3, s(500), bal=-5), _row(14, 3, s(503)),
    # null and unknown account
    _row(15, None, s(600)), _row(16, 99, s(601)),
    # amount exactly 500,000 and balance exactly 0: clean
    _row(17, 2, s(700), amount=500000, bal=0),
    # empty state and null state on physical channels; mismatch on ATM; home state null
    _row(18, 1, s(800), channel="ATM", state=""), _row(19, 1, s(900), channel="BRANCH", state=None),
    _row(20, 2, s(1000), channel="ATM", state="S9"), _row(21, 4, s(1100), channel="ATM", state="S9"),
]


def test_first_match_edge_cases(spark):
    got = _spark_first_match(spark, EDGE_ROWS, EDGE_HOMES)
    assert got == first_match_reference(EDGE_ROWS, EDGE_HOMES)
    assert got[1] is None and got[2] is None            # zero gap
    assert got[3] == got[4] == "RAPID_TRANSACTIONS" and got[5] is None
    assert got[6] == got[7] == got[8] == "RAPID_TRANSACTIONS"
    assert got[9] == got[10] == "HIGH_AMOUNT"
    assert got[11] == got[12] == "DUPLICATE"
    assert got[13] == "NEGATIVE_BALANCE" and got[14] == "RAPID_TRANSACTIONS"
    assert got[15] == got[16] == "INVALID_ACCOUNT"
    assert got[17] is None
    assert got[18] is None and got[19] is None          # blank / null state
    assert got[20] == "LOCATION_MISMATCH" and got[21] is None


def test_independent_edge_cases(spark):
    got = _spark_independent(spark, EDGE_ROWS, EDGE_HOMES)
    assert got == independent_reference(EDGE_ROWS, EDGE_HOMES)
    assert (2, "RAPID_TRANSACTIONS") in got             # zero gap counts here
    assert (18, "LOCATION_MISMATCH") in got             # empty string is a state here
    assert (10, "DUPLICATE") in got and (9, "DUPLICATE") not in got


def test_bucket_edges(spark):
    """Rows straddling a 20 s bucket edge give the same tags as one big partition."""
    rows = [_row(1, 1, s(17)), _row(2, 1, s(21)), _row(3, 1, s(39)), _row(4, 1, s(41)), _row(5, 1, s(44)),
            _row(6, 1, s(59), amount=7), _row(7, 1, s(59), amount=7), _row(8, 1, s(62))]
    homes = {1: "S1"}
    small = _spark_first_match(spark, rows, homes, RuleConfig(bucket_seconds=20))
    assert small == first_match_reference(rows, homes)
    assert small == _spark_first_match(spark, rows, homes, RuleConfig(bucket_seconds=3600))
    assert _spark_independent(spark, rows, homes, RuleConfig(bucket_seconds=20)) == independent_reference(rows, homes)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_randomised_against_restatement(spark, seed):
    rnd = random.Random(seed)
    homes = {a: rnd.choice(["S1", "S2", "S3", "", None]) for a in range(1, 6)}
    rows, t = [], 0.0
    for tid in range(1, 301):
        t += rnd.choice([0, 0, 1, 2, 3, 4, 5, 5, 6, 7, 15])
        acct = rnd.choice([1, 2, 3, 4, 5, 5, 5, 77, None])
        rows.append(_row(tid, acct, s(t), amount=rnd.choice([10, 10, 20, 600000]),
                         bal=rnd.choice([5, 5, 5, -1]), ttype=rnd.choice(["DEBIT", "CREDIT"]),
                         channel=rnd.choice(["UPI", "ATM", "BRANCH"]), state=rnd.choice(["S1", "S2", "", None])))
    for bucket in (20, 3600):
        cfg = RuleConfig(bucket_seconds=bucket)
        assert _spark_first_match(spark, rows, homes, cfg) == first_match_reference(rows, homes)
        assert _spark_independent(spark, rows, homes, cfg) == independent_reference(rows, homes)


def test_repeated_transaction_id_drops_all_rows(spark):
    rows = [_row(1, 1, s(0)), _row(1, 1, s(100), amount=900000), _row(2, 1, s(200))]
    raw, acc, cust = _frames(spark, rows, {1: "S1"})
    tagged = Q.tag_first_match(raw, acc, cust)
    assert [r.transaction_id for r in Q.clean(tagged).collect()] == [2]
    m = Q.run_metrics(tagged).collect()[0]
    assert (m.source_record_count, m.valid_record_count, m.invalid_record_count, m.anomaly_count) == (3, 1, 2, 1)


def test_empty_raw_gives_no_run(spark):
    raw, acc, cust = _frames(spark, [], {1: "S1"})
    tagged = Q.tag_first_match(raw, acc, cust)
    assert tagged.count() == 0
    assert Q.run_metrics(tagged).count() == 0


# ---------------------------------------------------------------- fixtures: planted truth

@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_planted_truth_fully_detected(spark, sf):
    from quillstone.plans.context import Ledger
    led = Ledger(spark, sf)
    rows = Q.compare_truth(led.anomalies, Q.planted_truth(led.raw)).collect()
    assert {r.anomaly_type for r in rows} == {
        "HIGH_AMOUNT", "INVALID_ACCOUNT", "NEGATIVE_BALANCE", "DUPLICATE", "RAPID_TRANSACTIONS", "LOCATION_MISMATCH"}
    assert all(r.missed == 0 and r.unexpected == 0 and r.planted == r.matched for r in rows)


def test_fixture_counts_sf001(spark):
    from quillstone.plans.context import Ledger
    led = Ledger(spark, "/root/testdata/sf0.001")
    counts = {r[0]: r[1] for r in led.tagged.groupBy("anomaly_type").count().collect()}
    assert counts == {None: 1476, "HIGH_AMOUNT": 4, "INVALID_ACCOUNT": 3, "NEGATIVE_BALANCE": 4, "DUPLICATE": 8,
                      "RAPID_TRANSACTIONS": 8, "LOCATION_MISMATCH": 5}


# ---------------------------------------------------------------- plan shape

def test_rules_use_one_window_exchange_and_one_sort(spark):
    """First-match rules after execution: one shuffle and one sort by (account,
    bucket), copy groups found by a partial (map-side) aggregate."""
    import re
    from quillstone.plans.context import Ledger
    led = Ledger(spark, "/root/testdata/sf0.001")
    f = Q.tag_first_match(led.raw, led.accounts, led.customers)
    f.collect()
    plan = f._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    bucket_exchanges = re.findall(r"Exchange hashpartitioning\(account_id#\d+L, _pb#\d+L", final)
    assert len(bucket_exchanges) == 1, final
    assert re.search(r"HashAggregate\(keys=\[account_id#\d+L, transaction_timestamp#\d+, amount#\d+, "
                     r"transaction_type#\d+\], functions=\[partial_count", final), final
    # every window sort is on (account, bucket, ts, amount, type, id): one sort per window consumer
    sorts = re.findall(r"Sort \[account_id#\d+L ASC NULLS FIRST, _pb#\d+L ASC NULLS FIRST, transaction_timestamp", final)
    assert len(sorts) == 1, final


def test_hot_copy_group_is_one_window_row(spark):
    """A copy group of 3,000 rows on one account enters the window stage as one row."""
    rows = [_row(i, 1, s(50), amount=10) for i in range(1, 3001)]
    rows += [_row(5001, 1, s(47)), _row(5002, 1, s(53)), _row(5003, 1, s(58))]
    homes = {1: "S1"}
    got = _spark_first_match(spark, rows, homes)
    assert got == first_match_reference(rows, homes)
    assert got[5001] is None and got[5002] == got[5003] == "RAPID_TRANSACTIONS"
    assert sum(1 for v in got.values() if v == "DUPLICATE") == 3000
    assert _spark_independent(spark, rows, homes) == independent_reference(rows, homes)
