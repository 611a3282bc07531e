"""Whole rows are not moved where few keys have something to tell: the rules, the clean ledger, reports."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstone.operators import quality as Q
from quillstone.plans.context import Ledger
from quillstone.schemas import TRANSACTIONS
from quillstone.session import scratch_path

SF = "/root/testdata/sf0.01"


class Seen(Ledger):
    """A ledger that tells the plan of what it stores."""

    def _stored(self, name, df, spread=False):
        self.__dict__.setdefault("plans", {})[name] = df._jdf.queryExecution().executedPlan().toString()
        return super()._stored(name, df, spread)


@pytest.fixture(scope="module")
def seen(spark):
    """Raw and tagged rows are well above the limit of a broadcast, marks below it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    yield Seen(spark, SF, materialize=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tagging_moves_no_whole_rows(seen):
    seen.tagged
    assert "SortMergeJoin" not in seen.plans["tagged"] and "Exchange hashpartitioning" not in seen.plans["tagged"]


def odd_rows(spark):
    """Rows (id, account, seconds, amount, balance, state): null and unknown accounts, other states, copies, bursts."""
    blank = dict.fromkeys(TRANSACTIONS.names)
    rows = [(1, 1, 0, 5, 1, "S1"), (2, 1, 3, 5, 1, None), (3, 1, 60, 5, 1, "S2"), (4, None, 0, 5, 1, "S1"), (5, None, 0, 5, 1, None), (6, 9, 0, 5, 1, None),
            (7, 2, 0, 5, -1, "S2"), (8, 2, 2, 5, 1, "S2"), (9, 2, 100, 7, 1, "S2"), (10, 2, 100, 7, -1, "S9"), (11, 2, 103, 7, 1, ""),
            (12, 3, 0, 5, 1, "S1"), (13, 3, 50, 5, 1, None), (None, 1, 500, 5, 1, "S1"), (14, 2, None, 5, 1, "S2"), (14, 2, None, 5, 1, "S2")]
    made = [tuple({**blank, "transaction_id": i, "account_id": a, "transaction_timestamp": None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s),
                   "amount": Decimal(m), "balance_after": Decimal(b), "transaction_type": "DEBIT", "channel": "ATM", "state": st, "status": "SUCCESS"}.values())
            for i, a, s, m, b, st in rows]
    people = (spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "account_id long, customer_id long"),
              spark.createDataFrame([(1, "S1"), (2, "S2"), (3, None)], "customer_id long, state string"))
    return spark.createDataFrame(made, TRANSACTIONS), people


@pytest.mark.parametrize("store", [False, True])
def test_tags_and_home_states_of_odd_rows(spark, store):
    raw, people = odd_rows(spark)

    def keep(name, df):
        path = scratch_path(spark, "test-marks", name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    got = Q.tag_first_match(raw, *people, keep=keep if store else Q.as_is).select("transaction_id", "home_state", "anomaly_type").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (1, "S1", "RAPID_TRANSACTIONS"), (2, "S1", "RAPID_TRANSACTIONS"), (3, "S1", "LOCATION_MISMATCH"), (4, None, "INVALID_ACCOUNT"), (5, None, "INVALID_ACCOUNT"),
        (6, None, "INVALID_ACCOUNT"), (7, "S2", "NEGATIVE_BALANCE"), (8, "S2", "RAPID_TRANSACTIONS"), (9, "S2", "DUPLICATE"), (10, "S2", "NEGATIVE_BALANCE"),
        (11, "S2", "RAPID_TRANSACTIONS"), (12, None, None), (13, None, None), (None, "S1", None), (14, "S2", "DUPLICATE"), (14, "S2", "DUPLICATE")], key=str)


def test_the_clean_ledger_moves_no_whole_rows(seen):
    assert "SortMergeJoin" not in plan(seen.tx)
    assert seen.tx.count() == Q.clean(seen.tagged).count()


def test_ids_on_tagged_and_untagged_rows(spark):
    raw, people = odd_rows(spark)
    again = raw.unionByName(raw.where("transaction_id = 12").withColumn("amount", F.lit(900000).cast("decimal(14,2)")))
    clean = Q.clean(Q.tag_first_match(again, *people))
    assert sorted((r.transaction_id for r in clean.collect()), key=str) == [13, None]


def test_merchant_categories_move_no_whole_rows(seen):
    from quillstone.operators import dashboard as D
    from quillstone.operators import views as V
    assert "SortMergeJoin" not in plan(D.top_merchant_categories(V.merchant_category_performance(seen.merchants, seen.tx), 8))


def test_the_manifest_reads_the_clean_ledger_without_moving_its_ids(seen):
    from quillstone.plans.reports import report_manifest
    text = plan(report_manifest(seen))
    assert not [line for line in text.splitlines() if "hashpartitioning(transaction_id" in line]


@pytest.fixture(scope="module")
def seen_below(spark):
    """Marks are above the limit of a broadcast too."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    yield Seen(spark, SF, materialize=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_manifest_moves_no_whole_rows_when_marks_pass_the_limit(seen_below):
    from quillstone.plans.reports import report_manifest
    report_manifest(seen_below)
    assert "SortMergeJoin" not in seen_below.plans["tagged"] and "SortMergeJoin" not in plan(seen_below.tx)


def test_merchant_categories_join_sums_only_when_marks_pass_the_limit(seen_below):
    """The one sort-merge join is of the merchants with their sums; the clean ledger is made without any."""
    from quillstone.operators import dashboard as D
    from quillstone.operators import views as V
    text = plan(D.top_merchant_categories(V.merchant_category_performance(seen_below.merchants, seen_below.tx), 8))
    assert text.count("SortMergeJoin") == 1
    assert "SortMergeJoin" not in seen_below.plans["mixed_ids"]


def test_only_few_marks_are_broadcast(spark):
    few = spark.range(5)
    assert "ResolvedHint" in Q.broadcast_few(few, 5)._jdf.queryExecution().analyzed().toString()
    assert Q.broadcast_few(few, 4) is few
