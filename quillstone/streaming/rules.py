"""Structured Streaming versions of the quality rules and channel volume.

The reference has no streaming; these are what a Spark user builds from the
batch rules (see README). Sources are file streams of raw transactions; the
event time is ``transaction_timestamp`` read as a session-zone TIMESTAMP
(watermarks need TIMESTAMP, not TIMESTAMP_NTZ).

* S1 ``row_rule_stream``: the four row-level rules (HIGH_AMOUNT,
  INVALID_ACCOUNT, NEGATIVE_BALANCE, LOCATION_MISMATCH) - stateless
  expressions plus a stream-static join with the account lookup; append.
* S2 ``first_match_stream``: the full first-match tagging with
  ``applyInPandasWithState``, keyed by a hash slot of the account. A row is decided once the watermark has
  passed its timestamp + the rapid gap (every row that can change its tag has
  then arrived); rows stay in state one more gap as predecessor context.
* S3 ``channel_volume_stream``: tumbling or sliding event-time windows per
  channel with a watermark; append emits each window once it is final.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..config import DEFAULT_RULES, RuleConfig
from ..operators.quality import home_states
from ..schemas import TRANSACTIONS

EVENT_TIME = "event_time"
#: The end-of-input row of a landing: its status, and how long after the last row it is.
END_OF_INPUT = "END_OF_INPUT"
END_AFTER_DAYS = 3650
_PHYSICAL = list(C.PHYSICAL_CHANNELS)


def read_transaction_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream of raw transactions with the declared schema. ``files_per_batch``: as many as ``land_files`` made for a slice."""
    r = spark.readStream.schema(TRANSACTIONS)
    files_per_batch = files_per_batch or slice_parts(spark)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path).withColumn(EVENT_TIME, F.col("transaction_timestamp").cast("timestamp"))


def slice_parts(spark: SparkSession) -> int:
    """Files, and so tasks, of one time slice of a landing."""
    return max(1, spark.sparkContext.defaultParallelism)


def land_files(df: DataFrame, path: str, n_slices: int = 4, parts: int | None = None) -> str:
    """Write a batch frame into a landing folder as ``n_slices`` time slices of ``parts`` files each.

    Slice bounds are approximate quantiles of the timestamp (one small aggregate); a file
    stream that takes ``parts`` files a trigger replays the slices in order, each in
    parallel. The last file holds the end-of-input row, long after all others: when the
    stream has read it, the watermark has passed every row and window, so nothing stays
    undecided. The streams below give no result for that row itself.
    """
    parts = parts or slice_parts(df.sparkSession)
    us = F.unix_micros(F.col("transaction_timestamp").cast("timestamp"))
    probs = [i / n_slices for i in range(1, n_slices)]
    row = df.agg(F.percentile_approx(us, probs, 10000).alias("cuts"), F.max("transaction_timestamp").alias("last")).first()
    bounds = [None, *sorted(set(row["cuts"] or [])), None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (us >= F.lit(lo))
        if hi is not None:
            cond = cond & (us < F.lit(hi))
        df.where(cond).repartition(parts).write.mode("append").parquet(path)
    land_end(df, path, row["last"])
    return path


def land_end(df: DataFrame, path: str, last) -> None:
    """The end-of-input row of a landing whose newest row is of ``last`` (none for an empty one)."""
    if last is not None:
        end = {c: F.lit(None).cast(t) for c, t in df.dtypes}
        end |= {"transaction_timestamp": F.timestamp_add("DAY", F.lit(END_AFTER_DAYS), F.lit(last).cast("timestamp_ntz")),
                "status": F.lit(END_OF_INPUT)}
        df.sparkSession.range(1, numPartitions=1).select(*[c.alias(n) for n, c in end.items()]).write.mode("append").parquet(path)


def land_shuffled(df: DataFrame, path: str, n_slices: int = 4, parts: int | None = None) -> str:
    """A landing whose slices each hold rows of all times: most rows of the later ones come behind the watermark."""
    parts = parts or slice_parts(df.sparkSession)
    for i in range(n_slices):
        df.where(F.pmod(F.xxhash64("transaction_id"), F.lit(n_slices)) == i).repartition(parts).write.mode("append").parquet(path)
    land_end(df, path, df.agg(F.max("transaction_timestamp")).first()[0])
    return path


def is_end(status: str = "status") -> Column:
    return F.col(status).eqNullSafe(F.lit(END_OF_INPUT))


# ---------------------------------------------------------------- S1

def row_rule_stream(stream: DataFrame, accounts: DataFrame, customers: DataFrame,
                    cfg: RuleConfig = DEFAULT_RULES) -> DataFrame:
    """One output row per (transaction, row rule) hit."""
    j = stream.where(~is_end()).join(home_states(accounts, customers), "account_id", "left")
    st, home = F.col("state"), F.col("home_state")

    def hit(cond, name):
        return F.when(F.coalesce(cond, F.lit(False)),
                      F.struct(F.lit(name).alias("anomaly_type"), F.lit(C.SEVERITY[name]).alias("severity")))

    hits = F.array_compact(F.array(
        hit(F.col("amount") > F.lit(cfg.high_amount), "HIGH_AMOUNT"),
        hit(F.col("_known").isNull(), "INVALID_ACCOUNT"),
        hit(F.col("balance_after") < 0, "NEGATIVE_BALANCE"),
        hit(F.col("_known") & F.col("channel").isin(*C.PHYSICAL_CHANNELS) & st.isNotNull() & home.isNotNull()
            & (st != home), "LOCATION_MISMATCH"),
    ))
    return (j.select("transaction_id", "account_id", "transaction_timestamp", F.explode(hits).alias("_h"))
            .select("transaction_id", "account_id", "transaction_timestamp", "_h.anomaly_type", "_h.severity"))


# ---------------------------------------------------------------- S3

def channel_volume_stream(stream: DataFrame, window: str = "1 day", slide: str | None = None,
                          watermark: str = "1 hour") -> DataFrame:
    """S3: count and value per channel and event-time window."""
    w = F.window(EVENT_TIME, window, slide) if slide else F.window(EVENT_TIME, window)
    agg = (stream.withWatermark(EVENT_TIME, watermark).groupBy(w.alias("w"), "channel")
           .agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").alias("_v")))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), "channel", "transactions",
                      F.round(F.col("_v").cast("double"), 2).alias("total_amount"))


# ---------------------------------------------------------------- S2

S2_OUT = "transaction_id long, account_id long, transaction_timestamp timestamp_ntz, anomaly_type string"
S2_STATE = ("account_id array<long>, transaction_id array<long>, ts array<timestamp_ntz>, amount array<double>, "
            "tx_type array<string>, row_tag array<string>, state array<string>, channel array<string>, "
            "home array<string>, emitted array<boolean>")
_STATE_COLS = ["account_id", "transaction_id", "ts", "amount", "tx_type", "row_tag", "state", "channel", "home",
               "emitted"]
_ORDER = ["account_id", "ts", "amount", "tx_type", "transaction_id"]


def _decide(buf: pd.DataFrame, gap: pd.Timedelta) -> pd.Series:
    """First-match tags of buffered rows sorted by (account, ts, amount, type, id).

    Row rules come in as ``row_tag``; duplicate, rapid and location are decided
    here, per account, with vectorised shifts.
    """
    size = buf.groupby(["account_id", "ts", "amount", "tx_type"], dropna=False)["transaction_id"].transform("size")
    copies = pd.Series("DUPLICATE", index=buf.index, dtype=object).where(size > 1, None)
    t4 = buf.row_tag.astype(object).where(buf.row_tag.notna(), copies)
    same_prev = buf.account_id.eq(buf.account_id.shift(1))
    same_next = buf.account_id.eq(buf.account_id.shift(-1))
    d = buf.ts - buf.ts.shift(1)
    hit = t4.isna() & same_prev & (d > pd.Timedelta(0)) & (d <= gap)
    rapid = hit | (hit.shift(-1, fill_value=False).astype(bool) & same_next)
    loc = (buf.channel.isin(_PHYSICAL) & buf.state.notna() & buf.home.notna()
           & (buf.state != "") & (buf.home != "") & (buf.state != buf.home))
    tag = t4.copy()
    tag[tag.isna() & rapid] = "RAPID_TRANSACTIONS"
    tag[tag.isna() & loc] = "LOCATION_MISMATCH"
    return tag


def _tag_slot(cfg: RuleConfig):
    gap = pd.Timedelta(seconds=cfg.rapid_seconds)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = []
        if state.exists:
            frames.append(pd.DataFrame({c: list(v) for c, v in zip(_STATE_COLS, state.get)}))
        for pdf in pdfs:
            if len(pdf):
                frames.append(pd.DataFrame({
                    "account_id": pdf.account_id, "transaction_id": pdf.transaction_id,
                    "ts": pdf.transaction_timestamp, "amount": pdf.amount.astype(float),
                    "tx_type": pdf.transaction_type, "row_tag": pdf._row_tag, "state": pdf.state,
                    "channel": pdf.channel, "home": pdf.home_state, "emitted": False}))
        if not frames:
            return
        buf = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        buf["ts"] = pd.to_datetime(buf["ts"])
        buf["emitted"] = buf["emitted"].astype(bool)
        buf = buf.sort_values(_ORDER, kind="mergesort").reset_index(drop=True)
        wm = state.getCurrentWatermarkMs()
        watermark = pd.Timestamp(wm, unit="ms") if wm and wm > 0 else pd.Timestamp.min
        tags = _decide(buf, gap)
        final = ~buf.emitted & (buf.ts + gap < watermark)
        if final.any():
            out = buf[final]
            yield pd.DataFrame({"transaction_id": out.transaction_id.astype("int64"), "account_id": out.account_id,
                                "transaction_timestamp": out.ts, "anomaly_type": tags[final].values})
        buf.loc[final, "emitted"] = True
        keep = buf[~(buf.emitted & (buf.ts + gap + gap < watermark))]
        if len(keep) == 0:
            state.remove()
            return
        state.update(tuple(list(keep[c]) for c in _STATE_COLS))
        pending = keep[~keep.emitted]
        nxt = (pending.ts.min() if len(pending) else keep.ts.max() + gap) + gap + pd.Timedelta(milliseconds=1)
        state.setTimeoutTimestamp(int(nxt.tz_localize("UTC").timestamp() * 1000))

    return fn


def first_match_stream(stream: DataFrame, accounts: DataFrame, customers: DataFrame,
                       cfg: RuleConfig = DEFAULT_RULES, watermark: str = "1 minute",
                       slots: int | None = None) -> DataFrame:
    """First-match tags (rules 1-6) as a stateful stream.

    Row-level rules run as expressions before the state; duplicate, rapid and
    location decisions are made once the watermark passes ``ts + rapid_seconds``.
    State is keyed by a hash slot of the account (``slots`` groups, by default eight for
    each shuffle partition, so that they grow with the cluster; a checkpoint keeps the count
    it began with), and each call decides all of its accounts with vectorised pandas, so
    the Python call count does not grow with the number of accounts. Rows later than the
    watermark are dropped by Spark; ``write_late_rows`` keeps them.
    """
    slots = slots or 8 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = stream.join(home_states(accounts, customers), "account_id", "left")
    row_tag = (F.when(F.col("amount") > F.lit(cfg.high_amount), "HIGH_AMOUNT")
               .when(F.col("_known").isNull(), "INVALID_ACCOUNT")
               .when(F.col("balance_after") < 0, "NEGATIVE_BALANCE"))
    j = (j.withColumn("_row_tag", row_tag).withColumn("_slot", F.pmod(F.xxhash64("account_id"), F.lit(slots)))
         .withWatermark(EVENT_TIME, watermark))
    return j.groupBy("_slot").applyInPandasWithState(
        _tag_slot(cfg), S2_OUT, S2_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- late rows

def write_late_rows(stream: DataFrame, path: str, checkpoint: str, watermark: str = "1 minute") -> str:
    """Everything available, to a late sink: rows that a watermark of that delay drops in S2 and S3.

    A batch's late rows are those more than the delay behind the newest event of the batches
    before it. Both the rows and the batch's newest event are written by batch id, so a
    repeated batch replaces its own files.
    """
    spark = stream.sparkSession
    marks, late = f"{path}/marks", f"{path}/late"

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(~is_end())
        seen = None
        if batch_id:
            known = spark.read.schema("newest timestamp, batch_id long").parquet(marks)
            seen = known.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        rows.agg(F.max(EVENT_TIME).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        behind = F.lit(False) if seen is None else F.col(EVENT_TIME) < F.lit(seen) - F.expr(f"INTERVAL {watermark}")
        rows.where(behind).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return late


# ---------------------------------------------------------------- runner

def run_available_now(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> str:
    """Process everything available, then stop (exactly-once file sink + checkpoint)."""
    q = (df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


# the state function goes to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
