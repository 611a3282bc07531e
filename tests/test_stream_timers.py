"""S2 by buckets and timers: equal to the batch rules, bounded state, restart, late rows."""

import datetime as dt
import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from quillstone.config import RuleConfig
from quillstone.operators.quality import tag_first_match
from quillstone.plans.context import Ledger
from quillstone.schemas import TRANSACTIONS
from quillstone.session import scratch_path
from quillstone.streaming import timers
from quillstone.streaming.rules import land_files, read_transaction_stream, run_available_now

T0 = dt.datetime(2024, 1, 1)
CFG = RuleConfig(bucket_seconds=60)


def keys(df):
    return sorted(map(tuple, df.select("transaction_id", "account_id", "transaction_timestamp", "anomaly_type").collect()), key=str)


def transactions(spark, rows):
    """Rows (id, account, seconds, amount) as raw transactions."""
    blank = dict.fromkeys(TRANSACTIONS.names)
    from decimal import Decimal
    made = [tuple({**blank, "transaction_id": i, "account_id": a, "transaction_timestamp": T0 + dt.timedelta(seconds=s), "amount": Decimal(m), "balance_after": Decimal(1),
                   "transaction_type": "DEBIT", "channel": "UPI", "status": "SUCCESS"}.values()) for i, a, s, m in rows]
    return spark.createDataFrame(made, TRANSACTIONS)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """A state store and a Python worker for each partition and batch: two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(0, 20).selectExpr("id account_id", "id customer_id"), spark.range(0, 20).selectExpr("id customer_id", "'S1' state")


def run(spark, path, out, checkpoint, people, files=None, cfg=CFG, watermark="10 seconds"):
    stream = read_transaction_stream(spark, path, files_per_batch=files)
    with timers.timer_store(spark):
        run_available_now(timers.first_match_by_timers(stream, *people, cfg, watermark), out, checkpoint)
    return spark.read.parquet(out)


def burst(seed, n, accounts=5, span=3000):
    """Rows within seconds of each other, copies, equal times of different amounts."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        s, a = rng.randrange(span), rng.randrange(accounts)
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((len(rows), a, s, str(rng.choice([10, 10, 20, 600_000]))))
            s += rng.choice([0, 0, 1, 4, 5, 6])
    return rows


def test_stream_input_equals_the_batch_rules(spark):
    led = Ledger(spark, SF_SMALL)
    raw = led.fx.stream_input()
    base = scratch_path(spark, "test-timers-a")
    land_files(raw, f"{base}/in", n_slices=3, parts=2)
    got = run(spark, f"{base}/in", f"{base}/out", f"{base}/ck", (led.accounts, led.customers), 2, RuleConfig(), "1 minute")
    assert keys(got) == keys(tag_first_match(raw, led.accounts, led.customers))


def test_restart_from_a_checkpoint(spark, people):
    """The first files, a stop, then the others: rows kept in state by the first run are decided by the second."""
    raw = transactions(spark, burst(1, 300)).cache()
    base = scratch_path(spark, "test-timers-b")
    cut = T0 + dt.timedelta(seconds=1500)
    raw.where(F.col("transaction_timestamp") < cut).coalesce(1).write.mode("append").parquet(f"{base}/in")
    first = run(spark, f"{base}/in", f"{base}/out", f"{base}/ck", people, 1).count()
    assert 0 < first < raw.where(F.col("transaction_timestamp") < cut).count()
    land_files(raw.where(F.col("transaction_timestamp") >= cut), f"{base}/in", n_slices=1, parts=1)
    got = run(spark, f"{base}/in", f"{base}/out", f"{base}/ck", people, 1)
    assert keys(got) == keys(tag_first_match(raw, *people, CFG))


def test_state_of_a_hot_account_is_bounded(spark, people):
    """One account, fifteen batches of a hundred seconds: state holds what a bucket, the delay and a gap hold, not all that came."""
    base = scratch_path(spark, "test-timers-c")
    raw = transactions(spark, [(i, 1, i, str(i % 7)) for i in range(1500)]).cache()
    for i in range(15):
        raw.where(F.col("transaction_id").between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = read_transaction_stream(spark, f"{base}/in", files_per_batch=1)
    with timers.timer_store(spark):
        q = (timers.first_match_by_timers(stream, *people, CFG, "10 seconds").writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    size = [p.stateOperators[0].memoryUsedBytes for p in q.recentProgress if p.stateOperators]
    assert len(held) >= 15
    # rows of two batches and a bucket with its ghosts, a timer and an index entry for each of a few keys
    assert max(held) <= 100 + 100 + 60 + 10 + 2 * 6 + 40, held
    assert max(size[5:]) <= 2 * max(size[:5]) + 1_000_000
    got = keys(spark.read.parquet(f"{base}/out"))  # the last buckets wait for later data
    assert len(got) > 1200 and set(got) <= set(keys(tag_first_match(raw, *people, CFG)))


@pytest.mark.parametrize("seed", range(1))
def test_any_order_of_arrival(spark, people, seed):
    """Rows come in any order, so many are dropped as late; the stream's result with the corrections is that of the batch rules."""
    rows = burst(10 + seed, 400)
    raw = transactions(spark, rows).cache()
    base = scratch_path(spark, f"test-timers-d{seed}")
    for i in range(4):
        raw.where(F.pmod(F.hash("transaction_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    land_files(raw.limit(0).unionByName(raw.where(F.col("transaction_id") == len(rows) - 1)), f"{base}/extra", n_slices=1, parts=1)
    spark.read.parquet(f"{base}/extra").where("status = 'END_OF_INPUT'").coalesce(1).write.mode("append").parquet(f"{base}/in")
    landed = spark.read.schema(TRANSACTIONS).parquet(f"{base}/in")
    decided = run(spark, f"{base}/in", f"{base}/out", f"{base}/ck", people, 1)
    late = timers.missing_rows(landed, decided)
    assert late.count() > 20
    changes = timers.corrections(landed, decided, late, *people, CFG)
    expected = keys(tag_first_match(raw, *people, CFG))
    assert keys(timers.corrected(decided, changes)) == expected
    assert changes.where("weight < 0").count() > 0
    # naming rows that are not late changes nothing
    every = timers.corrections(landed, decided, landed.where("status = 'SUCCESS'"), *people, CFG)
    assert keys(timers.corrected(decided, every)) == expected


def test_only_touched_pairs_are_decided_again(spark, people):
    raw = transactions(spark, [(i, i % 5, i * 10, "5") for i in range(500)] + [(900, 1, 2001, "5")])
    decided = tag_first_match(raw.where("transaction_id < 900"), *people, CFG)
    late = raw.where("transaction_id = 900")
    changes = timers.corrections(raw, decided, late, *people, CFG)
    got = sorted((r["transaction_id"], r["anomaly_type"], r["weight"]) for r in changes.collect())
    # 2010 s is account 1's next row (9 s on): outside the gap; 1960 s its last
    assert got == [(900, None, 1)]
    assert timers.corrections(raw, tag_first_match(raw, *people, CFG), late, *people, CFG).count() == 0


def test_tags_of_a_bucket():
    row = lambda i, s, amount=1.0, own=True, tag=None, far=False: (own, i, 7, s * 1_000_000, amount, "D", tag, far)
    tags = lambda rows: {r[1]: t for r, t in timers.bucket_tags(rows, 5_000_000)}
    assert tags([row(1, 0), row(2, 5), row(3, 11)]) == {1: "RAPID_TRANSACTIONS", 2: "RAPID_TRANSACTIONS", 3: None}
    assert tags([row(1, 0), row(2, 0), row(3, 1, own=False)]) == {1: "DUPLICATE", 2: "DUPLICATE"}
    assert tags([row(1, 0, tag="HIGH_AMOUNT"), row(2, 3)]) == {1: "HIGH_AMOUNT", 2: "RAPID_TRANSACTIONS"}
    assert tags([row(1, 0, far=True), row(2, 9)]) == {1: "LOCATION_MISMATCH", 2: None}


def test_a_slot_keeps_its_accounts_apart():
    """Equal times and near ones of different accounts, of a null and of account 0, are no copies and not rapid."""
    import pandas as pd
    rows = [(True, False, 1, False, 0, 0, 1.0, "=D", 0, False), (True, False, 2, True, 0, 0, 1.0, "=D", 0, False), (True, False, 3, False, 8, 2_000_000, 1.0, "=D", 0, True),
            (True, False, 4, False, 8, 9_000_000, float("-inf"), "", 0, False), (True, True, 0, False, 8, 9_000_000, float("-inf"), "", 2, False)]
    frame = pd.DataFrame(rows, columns=timers.ROW)
    order, tags = timers.slot_tags(frame, 5_000_000)
    got = {(frame["transaction_id"][i], bool(frame["no_account"][i])): timers.TAGS[t] for i, t in zip(order, tags)}
    assert got == {(1, False): None, (2, True): None, (3, False): "LOCATION_MISMATCH", (4, False): "DUPLICATE", (0, False): "INVALID_ACCOUNT"}


def test_rows_of_touched_pairs_are_read_once(spark, people):
    raw = transactions(spark, burst(3, 200))
    decided = tag_first_match(raw.where("transaction_id % 3 > 0"), *people, CFG)
    kept = {}

    def keep(name, df):
        path = scratch_path(spark, "test-timers-kept", name)
        df.write.mode("overwrite").parquet(path)
        kept[name] = spark.read.parquet(path)
        return kept[name]

    changes = timers.corrections(raw, decided, raw.where("transaction_id % 3 = 0"), *people, CFG, keep)
    assert {"touched_pairs", "touched_rows", "rule_marks", "account_marks"} == set(kept)
    assert keys(timers.corrected(decided, changes)) == keys(tag_first_match(raw, *people, CFG))
