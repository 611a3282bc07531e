"""S2 with per-bucket list state and event-time timers, and what becomes of rows that come too late.

``first_match_by_timers`` is the first-match tagging on ``transformWithStateInPandas``. A key is
a hash slot of accounts and one time bucket, as in the batch rules: a row goes to its own bucket
and, within the rapid gap of an edge, as a ghost to the neighbour's. A key's rows are only ever
appended to a list in the state store, an Arrow batch at a time; the key has one timer, one gap
after its bucket ends, at which all rows that can change a tag of the bucket have arrived. The
timer reads the list once, decides all accounts of the slot with vectorised numpy, emits the
bucket's tags and clears the key. So nothing is rewritten batch by batch, calls to Python and the
state store do not grow with the accounts, a hot account spreads over the tasks by its buckets,
and what is in state is bounded by the rows of a bucket, the watermark delay and a gap.

Rows behind the watermark are dropped by Spark. ``corrections`` merges them back: only the
(account, bucket) pairs within a gap of a missing row are decided again, over the landed rows of
those pairs and their neighbours, and the difference from what the stream has emitted leaves as
retractions (weight below 0) and assertions (above 0). ``corrected`` applies them; the result
equals the batch rules over all rows, whatever the order of arrival.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C
from ..config import DEFAULT_RULES, RuleConfig
from ..operators.quality import TS, Keep, as_is, bucket_roles, home_states, tag_first_match
from .rules import EVENT_TIME, is_end

#: The state store that transformWithState needs (a session setting).
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = "transaction_id long, account_id long, transaction_timestamp timestamp_ntz, anomaly_type string"
#: A row of a key. Nulls are told apart by columns of their own, and a null amount or type comes before all others.
ROW = ["own", "no_id", "transaction_id", "no_account", "account_id", "us", "amount", "tx_type", "row_tag", "far"]
#: Rows in state: one element for each Arrow batch that came, its rows as an Arrow stream.
LISTED = "rows binary"
TAGS = [None, *(name for name, _ in C.RULES)]
_COPY, _RAPID, _FAR = (TAGS.index(t) for t in ("DUPLICATE", "RAPID_TRANSACTIONS", "LOCATION_MISMATCH"))


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within use the RocksDB state store; the session's setting is put back."""
    before = spark.conf.get(STORE_KEY)
    spark.conf.set(STORE_KEY, STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE_KEY, before)


def slot_tags(rows: pd.DataFrame, gap_us: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which rows (ROW) of some accounts and one bucket, with its ghosts, are decided, and in it their places in TAGS.

    An account's rows are ordered by time, amount, type and id. A row is rapid if it is clean so far and
    follows its predecessor by a gap at most, but not at once; the predecessor, if clean, is too.
    """
    types = np.unique(rows["tx_type"].to_numpy(dtype=object), return_inverse=True)[1]
    keys = [rows["no_account"].to_numpy(), rows["account_id"].to_numpy(), rows["us"].to_numpy(), rows["amount"].to_numpy(), types]
    order = np.lexsort([rows["transaction_id"].to_numpy(), ~rows["no_id"].to_numpy(), *reversed(keys)])
    no_account, account, us, amount, types = (k[order] for k in keys)
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (account[1:] == account[:-1]) & (no_account[1:] == no_account[:-1])
    step = np.diff(us, prepend=us[:1])
    copy = same & (step == 0) & (amount == np.roll(amount, 1)) & (types == np.roll(types, 1))
    group = np.cumsum(~copy) - 1
    tags = rows["row_tag"].to_numpy()[order].astype(int)
    tags[(tags == 0) & (np.bincount(group)[group] > 1)] = _COPY
    hit = same & (tags == 0) & (step > 0) & (step <= gap_us)
    near = hit | np.append(hit[1:], False)
    late = np.where(near, _RAPID, np.where(rows["far"].to_numpy()[order], _FAR, 0))
    return order, np.where(tags == 0, late, tags)


def bucket_tags(rows: list[tuple], gap_us: int) -> list[tuple]:
    """(row, tag) of a bucket's own rows; `rows` are tuples (own, id, account, us, amount, type, tag or None, far) of one bucket with its ghosts."""
    frame = pd.DataFrame([(own, i is None, i or 0, a is None, a or 0, us, float("-inf") if m is None else float(m), "" if t is None else f"={t}",
                           TAGS.index(tag), far) for own, i, a, us, m, t, tag, far in rows], columns=ROW)
    order, tags = slot_tags(frame, gap_us)
    return [(rows[i], TAGS[tag]) for i, tag in zip(order, tags) if rows[i][0]]


class BucketRules(StatefulProcessor):
    """Keeps the rows of one (account slot, bucket) until its timer, then tags them."""

    def __init__(self, bucket_seconds: int, gap_seconds: int):
        self.bucket_us, self.gap_us = bucket_seconds * 1_000_000, gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", LISTED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803 (the interface's name)
        for some in rows:
            batch = pa.RecordBatch.from_pandas(some[ROW], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            self.rows.appendValue((sink.getvalue().to_pybytes(),))
        # the same for every row of the key: registering it again changes nothing
        self.handle.registerTimer(((int(key[-1]) + 1) * self.bucket_us + self.gap_us) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        rows = pd.concat([pa.ipc.open_stream(bytes(r[0])).read_all().to_pandas() for r in self.rows.get()], ignore_index=True)
        self.rows.clear()
        order, tags = slot_tags(rows, self.gap_us)
        mine = rows["own"].to_numpy()[order]
        own, tags = rows.iloc[order[mine]], tags[mine]
        yield pd.DataFrame({
            "transaction_id": pd.arrays.IntegerArray(own["transaction_id"].to_numpy(), own["no_id"].to_numpy()),
            "account_id": pd.arrays.IntegerArray(own["account_id"].to_numpy(), own["no_account"].to_numpy()),
            "transaction_timestamp": own["us"].to_numpy().astype("datetime64[us]"), "anomaly_type": np.array(TAGS, dtype=object)[tags]})

    def close(self) -> None:
        pass


def first_match_by_timers(stream: DataFrame, accounts: DataFrame, customers: DataFrame, cfg: RuleConfig = DEFAULT_RULES,
                          watermark: str = "1 minute", slots: int | None = None) -> DataFrame:
    """First-match tags as a stream, decided when a bucket (``cfg.bucket_seconds``) and a gap are over.

    The session must use the RocksDB state store (``STORE_KEY``). Rows of a null account are one
    account, as in the batch rules. ``slots``: groups of accounts, by default eight for each shuffle
    partition, so that they grow with the cluster; a checkpoint must go on with the count it began with.
    """
    slots = slots or 8 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_tag = (F.when(F.col("amount") > F.lit(cfg.high_amount), TAGS.index("HIGH_AMOUNT"))
               .when(F.col("_known").isNull(), TAGS.index("INVALID_ACCOUNT")).when(F.col("balance_after") < 0, TAGS.index("NEGATIVE_BALANCE")).otherwise(0))
    st, home = F.col("state"), F.col("home_state")
    far = (F.col("channel").isin(*C.PHYSICAL_CHANNELS) & (st != "") & (home != "") & (st != home))
    us = F.unix_micros(F.col(TS).cast("timestamp"))
    rows = stream.withWatermark(EVENT_TIME, watermark).join(home_states(accounts, customers), "account_id", "left")
    rows = rows.select(F.col("transaction_id").isNull().alias("no_id"), F.coalesce("transaction_id", F.lit(0).cast("long")).alias("transaction_id"),
                       F.col("account_id").isNull().alias("no_account"), F.coalesce("account_id", F.lit(0).cast("long")).alias("account_id"),
                       us.alias("us"), F.coalesce(F.col("amount").cast("double"), F.lit(float("-inf"))).alias("amount"),
                       F.coalesce(F.concat(F.lit("="), "transaction_type"), F.lit("")).alias("tx_type"), row_tag.alias("row_tag"),
                       F.coalesce(far, F.lit(False)).alias("far"), EVENT_TIME, F.explode(bucket_roles(cfg)[1]).alias("_r"))
    rows = rows.withColumns({"_slot": F.pmod(F.xxhash64("account_id"), F.lit(slots)), "_bucket": F.col("_r.pb"), "own": F.col("_r.role") == "R"}).drop("_r")
    return rows.groupBy("_slot", "_bucket").transformWithStateInPandas(
        BucketRules(cfg.bucket_seconds, cfg.rapid_seconds), OUT, "append", "EventTime")


# ---------------------------------------------------------------- late rows

KEY = ["transaction_id", "account_id", TS]


def missing_rows(landed: DataFrame, decided: DataFrame) -> DataFrame:
    """Landed rows (KEY, and how many are missing) without a decision: those that came too late, and those not decided yet."""
    weights = (landed.where(~is_end()).select(*KEY, F.lit(1).alias("w")).unionByName(decided.select(*KEY, F.lit(-1).alias("w"))))
    return weights.groupBy(*KEY).agg(F.sum("w").alias("missing")).where(F.col("missing") > 0)


def _own_bucket(cfg: RuleConfig) -> Column:
    return bucket_roles(cfg)[0]


def corrections(landed: DataFrame, decided: DataFrame, late: DataFrame, accounts: DataFrame, customers: DataFrame,
                cfg: RuleConfig = DEFAULT_RULES, keep: Keep = as_is) -> DataFrame:
    """OUT's columns and ``weight``: what must be taken from (below 0) and added to (above 0) the decided rows.

    ``late`` (account_id, transaction_timestamp) tells where to look; naming rows that are not
    late costs work and changes nothing. Rows within a gap of a late one are in its bucket
    or a neighbour's; only these pairs are read, by equi joins. ``keep`` may store the pairs and
    their rows, which are read several times.
    """
    gap = F.make_interval(secs=F.lit(cfg.rapid_seconds))
    near = [late.select("account_id", when.cast("timestamp_ntz").alias(TS)) for when in (F.col(TS) - gap, F.col(TS) + gap)]
    touched = keep("touched_pairs", near[0].unionByName(near[1]).select(F.col("account_id").alias("_acc"), _own_bucket(cfg).alias("_b")).distinct())

    def within(rows: DataFrame, bucket: Column) -> DataFrame:
        rows = rows.withColumn("_bucket", bucket)
        return rows.join(touched, rows["account_id"].eqNullSafe(touched["_acc"]) & (rows["_bucket"] == touched["_b"]), "left_semi").drop("_bucket")

    # rows of touched pairs, and of their neighbours those within a gap of the edge: each once
    roles = bucket_roles(cfg)[1]
    around = landed.where(~is_end()).withColumn("_row", F.monotonically_increasing_id())
    places = within(around.select("_row", "account_id", F.explode(roles).alias("_r")), F.col("_r.pb")).select("_row").distinct()
    rows = keep("touched_rows", around.join(places, "_row", "left_semi").drop("_row"))
    again = tag_first_match(rows, accounts, customers, cfg, keep)
    new = within(again, _own_bucket(cfg)).select(*KEY, "anomaly_type", F.lit(1).alias("weight"))
    old = within(decided, _own_bucket(cfg)).select(*KEY, "anomaly_type", F.lit(-1).alias("weight"))
    return (new.unionByName(old).groupBy(*KEY, "anomaly_type").agg(F.sum("weight").cast("int").alias("weight")).where(F.col("weight") != 0))


def corrected(decided: DataFrame, changes: DataFrame) -> DataFrame:
    """The decided rows with the corrections applied."""
    every = decided.select(*KEY, "anomaly_type", F.lit(1).alias("weight")).unionByName(changes.select(*KEY, "anomaly_type", "weight"))
    left = every.groupBy(*KEY, "anomaly_type").agg(F.sum("weight").cast("int").alias("weight")).where(F.col("weight") > 0)
    return left.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).drop("_copy", "weight")


# the processor goes to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
