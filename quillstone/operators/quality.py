"""Data-quality rules and quarantine (Q1-Q10).

Two rule variants exist and both are offered:

* ``independent_anomalies`` (Q1): every rule alone over all raw rows, one
  output row per (transaction, rule); rules may overlap.
* ``tag_first_match`` (Q2): the rules in fixed order, at most one tag per row;
  DUPLICATE tags every member of a copy group, RAPID tags the later row and
  its predecessor.

Physical design (both variants share it, see ``rule_features``):

1. the account lookup (account -> home state) is made for the distinct
   (account, state) pairs, and only what differs goes back to the rows; Spark
   chooses broadcast or sort-merge from the measured size and AQE splits a
   skewed account on the sort-merge path;
2. the ordered rules need, per account, the previous and next row by
   (timestamp, id). Instead of one window partition per account (a hot
   account would be one task) rows are partitioned by
   ``(account_id, time bucket)``. A row within ``rapid_seconds`` of a bucket
   edge is also copied into the neighbour bucket as a *ghost*, so lag/lead
   at the edges see the true neighbour. Ghosts are dropped afterwards;
3. rows are aggregated on their copy key before any shuffle and only these
   narrow keys enter the windows, one for a copy group, so a group holding a
   large share of all rows never lands in one task, and whole rows are not
   moved as long as few keys have something to tell.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_RULES, RuleConfig
from ..functions.columns import format_money, is_physical
from ..schemas import TRANSACTION_COLUMNS



def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

TS = "transaction_timestamp"


#: What becomes of a named intermediate result: a caller may store it and give back the stored rows.
Keep = Callable[[str, DataFrame], DataFrame]


def as_is(name: str, df: DataFrame) -> DataFrame:
    return df


#: Stored marks of up to so many rows are broadcast whatever the session's limit (about 150 bytes a row in memory).
BROADCAST_MARKS = 1_000_000


def broadcast_few(stored: DataFrame, most: int = BROADCAST_MARKS) -> DataFrame:
    """A stored result, with a broadcast hint if it is known to have ``most`` rows or fewer; above, Spark decides by its size."""
    return F.broadcast(stored) if stored.count() <= most else stored


# ---------------------------------------------------------------- lookup

def home_states(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Account -> home state of its customer (null when the customer is unknown).

    One row per account id (``max`` makes a repeated key deterministic).
    """
    acc = accounts.select("account_id", "customer_id")
    cust = customers.select("customer_id", F.col("state").alias("home_state"))
    return (acc.join(cust, "customer_id", "left")
            .groupBy("account_id").agg(F.max("home_state").alias("home_state"))
            .withColumn("_known", F.lit(True)))


def with_home_states(rows: DataFrame, raw: DataFrame, accounts: DataFrame, customers: DataFrame, keep: Keep) -> DataFrame:
    """``rows`` (of ``raw``, with its account_id and state) with ``home_state`` and ``_known`` (true, or null for an unknown account).

    The lookup is made for the distinct (account, state) pairs, which are aggregated map-side:
    a hot account is a few pairs. Only pairs of unknown accounts or of another home state go
    back to the rows; all other rows are at home, so their home state is their own.
    """
    pairs = raw.select("account_id", "state").distinct().join(home_states(accounts, customers), "account_id", "left")
    away = F.col("_known").isNull() | ~F.col("state").eqNullSafe(F.col("home_state"))
    marks = keep("account_marks", pairs.where(away).select(
        F.col("account_id").alias("_a_account"), F.col("state").alias("_a_state"), F.col("home_state").alias("_a_home"),
        F.col("_known").alias("_a_known"), F.lit(True).alias("_away")))
    j = rows.join(marks, rows["account_id"].eqNullSafe(marks["_a_account"]) & rows["state"].eqNullSafe(marks["_a_state"]), "left")
    return j.withColumns({"home_state": F.when(F.col("_away"), F.col("_a_home")).otherwise(F.col("state")),
                          "_known": F.when(F.col("_away"), F.col("_a_known")).otherwise(F.lit(True))}) \
        .drop("_a_account", "_a_state", "_a_home", "_a_known", "_away")


# ---------------------------------------------------------------- features

def bucket_roles(cfg: RuleConfig) -> tuple[Column, Column]:
    """(bucket, array of (bucket, role)) for a row; role R = real, N/P = ghost."""
    bucket_us = cfg.bucket_seconds * 1_000_000
    gap_us = cfg.rapid_seconds * 1_000_000
    us = F.timestamp_diff("MICROSECOND", _epoch(), F.col(TS))
    b = F.floor(us / F.lit(float(bucket_us))).cast("long")
    off = us - b * F.lit(bucket_us)
    roles = F.array_compact(F.array(
        F.struct(b.alias("pb"), F.lit("R").alias("role")),
        # first rows of a bucket feed lead() of the previous bucket's last row
        F.when(off <= F.lit(gap_us), F.struct((b - 1).alias("pb"), F.lit("N").alias("role"))),
        # last rows of a bucket feed lag() of the next bucket's first row
        F.when(F.lit(bucket_us) - off <= F.lit(gap_us), F.struct((b + 1).alias("pb"), F.lit("P").alias("role"))),
    ))
    return b, roles


COPY_KEY = ["account_id", TS, "amount", "transaction_type"]


def rule_features(raw: DataFrame, accounts: DataFrame, customers: DataFrame,
                  cfg: RuleConfig = DEFAULT_RULES, copy_lag: bool = False, keep: Keep = as_is) -> DataFrame:
    """Per raw row: duplicate group size/rank, previous timestamp, lookup columns
    and the first-match tag of rules 1-4 plus the rapid flag.

    1. The four columns of the copy key (account, timestamp, amount, type; nulls equal)
       are aggregated to one row for each key; the partial step collapses a copy
       group map-side, so a group holding a large share of all rows costs one row
       after the combine.
    2. These narrow rows go through the ordered windows on one exchange by
       (account, time bucket) and one sort (order: ts, amount, type, a deterministic
       order of distinct keys). A copy row is always tagged DUPLICATE or by an earlier
       rule, so for its neighbours only its timestamp matters, which its key carries.
    3. Only keys with something to tell are kept: copies, and rows near a neighbour in
       time. They go back to the raw rows by a join on the copy key (broadcast when
       few, else sort-merge that AQE can split); ``keep`` may store them, so that
       their size is known before raw rows are moved (``broadcast_few``). Only the independent variant
       needs a group's first id and the previous timestamp of its rows (``copy_lag=True``).
    4. The account lookup comes last (``with_home_states``): whether an account is
       known is the same for every row of a window partition, so
       ``hit = known AND hit_without_lookup`` and likewise for ``lead(hit)``.
    """
    clean_so_far = ~F.coalesce(F.col("amount") > F.lit(cfg.high_amount), F.lit(False)) & \
        ~F.coalesce(F.col("balance_after") < 0, F.lit(False))
    first_id = [F.min("transaction_id").alias("_first_id")] if copy_lag else []
    x = raw.groupBy(*COPY_KEY).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(clean_so_far).alias("_ok"), *first_id)

    _, roles = bucket_roles(cfg)
    x = x.select("*", F.explode(roles).alias("_r")).select(
        "*", F.col("_r.pb").alias("_pb"), F.col("_r.role").alias("_role")).drop("_r")
    x = x.repartition("account_id", "_pb")
    seq = Window.partitionBy("account_id", "_pb").orderBy(F.col(TS), F.col("amount"), F.col("transaction_type"))
    x = x.withColumn("_prev_ts", F.lag(TS).over(seq))
    within = F.col(TS) <= F.timestamp_add("SECOND", F.lit(cfg.rapid_seconds), F.col("_prev_ts"))
    hit = F.coalesce(F.col("_ok") & (F.col("_n") == 1) & (F.col(TS) > F.col("_prev_ts")) & within, F.lit(False))
    x = x.withColumn("_hit0", hit).withColumn("_within", F.coalesce(within, F.lit(False)))
    x = x.withColumn("_next_hit0", F.coalesce(F.lead("_hit0").over(seq), F.lit(False)))
    x = x.where(F.col("_role") == "R")

    near = (F.col("_within") if copy_lag else F.col("_hit0")) | F.col("_next_hit0")
    told = ["_n", "_hit0", "_next_hit0"] + (["_first_id", "_prev_ts", "_within"] if copy_lag else [])
    marks = keep("rule_marks", x.where((F.col("_n") > 1) | near).select(*[F.col(k).alias(f"_g_{k}") for k in COPY_KEY], *told))
    x = raw.join(marks, [raw[k].eqNullSafe(marks[f"_g_{k}"]) for k in COPY_KEY], "left").select(*raw.columns, *told)

    copied = F.coalesce(F.col("_n") > 1, F.lit(False))
    x = x.withColumns({"_dup_n": F.coalesce("_n", F.lit(1).cast("long")),
                       "_hit0": F.coalesce("_hit0", F.lit(False)) & ~copied, "_next_hit0": F.coalesce("_next_hit0", F.lit(False)) & ~copied})
    if copy_lag:
        # each copy but the first follows one of its own time
        first = ~copied | F.coalesce(F.col("transaction_id") == F.col("_first_id"), F.lit(False))
        x = x.withColumns({"_dup_rank": F.when(first, 1).otherwise(2), "_prev_ts": F.when(first, F.col("_prev_ts")).otherwise(F.col(TS)),
                           "_within": F.when(first, F.coalesce("_within", F.lit(False))).otherwise(F.lit(True))}).drop("_first_id")
    x = x.drop("_n")

    x = with_home_states(x, raw, accounts, customers, keep)
    known = F.coalesce(F.col("_known"), F.lit(False))
    t4 = (F.when(F.col("amount") > F.lit(cfg.high_amount), "HIGH_AMOUNT")
          .when(~known, "INVALID_ACCOUNT")
          .when(F.col("balance_after") < 0, "NEGATIVE_BALANCE")
          .when(F.col("_dup_n") > 1, "DUPLICATE"))
    return x.withColumn("_t4", t4).withColumn("_rapid", known & (F.col("_hit0") | F.col("_next_hit0")))


def _location_mismatch(strict_blank: bool) -> Column:
    st, home = F.col("state"), F.col("home_state")
    cond = is_physical("channel") & st.isNotNull() & home.isNotNull() & (st != home)
    if strict_blank:  # the pipeline treats empty strings as missing
        cond = cond & (st != "") & (home != "")
    return F.coalesce(cond, F.lit(False))


# ---------------------------------------------------------------- Q2 first match

def _message(template: str, **values: Column | str) -> Column:
    """A message format with its {names} filled in from columns (or fixed text); null if a value is null."""
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        pieces += [F.lit(text)] if text else []
        if name:
            pieces.append(F.lit(values[name]) if isinstance(values[name], str) else values[name])
    return F.concat(*pieces)


def _first_match_description(tag: Column, cfg: RuleConfig) -> Column:
    acct = F.col("account_id").cast("string")
    return (
        F.when(tag == "HIGH_AMOUNT", _message(C.MSG_HIGH_AMOUNT, amount=format_money("amount"),
                                              threshold=format_money(F.lit(cfg.high_amount))))
        .when(tag == "INVALID_ACCOUNT", _message(C.MSG_INVALID_ACCOUNT, account_id=F.coalesce(acct, F.lit("nan"))))
        .when(tag == "NEGATIVE_BALANCE", _message(C.MSG_NEGATIVE_BALANCE, balance_after=format_money("balance_after")))
        .when(tag == "DUPLICATE", F.lit(C.MSG_DUPLICATE))
        .when(tag == "RAPID_TRANSACTIONS", _message(C.MSG_RAPID, account_id=acct, seconds=str(cfg.rapid_seconds)))
        .when(tag == "LOCATION_MISMATCH", _message(C.MSG_LOCATION, state=F.col("state"), home_state=F.col("home_state")))
    )


def _severity(tag: Column) -> Column:
    out = None
    for name, sev in C.RULES:
        out = F.when(tag == name, sev) if out is None else out.when(tag == name, sev)
    return out


def tag_first_match(raw: DataFrame, accounts: DataFrame, customers: DataFrame,
                    cfg: RuleConfig = DEFAULT_RULES, keep: Keep = as_is) -> DataFrame:
    """Q2: every raw row with ``anomaly_type``/``severity``/``description`` (null when clean)."""
    f = rule_features(raw, accounts, customers, cfg, keep=keep)
    tag = F.coalesce(F.col("_t4"),
                     F.when(F.col("_rapid"), F.lit("RAPID_TRANSACTIONS")),
                     F.when(_location_mismatch(strict_blank=True), F.lit("LOCATION_MISMATCH")))
    f = f.withColumn("anomaly_type", tag)
    return f.select(*TRANSACTION_COLUMNS, "home_state", "anomaly_type",
                    _severity(F.col("anomaly_type")).alias("severity"),
                    _first_match_description(F.col("anomaly_type"), cfg).alias("description"))


# ---------------------------------------------------------------- Q1 independent

def independent_anomalies(raw: DataFrame, accounts: DataFrame, customers: DataFrame,
                          cfg: RuleConfig = DEFAULT_RULES, keep: Keep = as_is) -> DataFrame:
    """Q1: union of the six independent rules, read in one pass (array of hits + explode)."""
    f = rule_features(raw, accounts, customers, cfg, copy_lag=True, keep=keep)

    def hit(cond: Column, name: str, desc: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(name).alias("anomaly_type"), F.lit(C.SEVERITY[name]).alias("severity"),
            desc.alias("description")))

    amount_s = F.col("amount").cast("string")
    hits = F.array_compact(F.array(
        hit(F.col("amount") > F.lit(cfg.high_amount), "HIGH_AMOUNT",
            _message(C.IND_MSG_HIGH_AMOUNT, amount=amount_s, threshold=f"{cfg.high_amount:,.0f}")),
        hit(F.col("_known").isNull(), "INVALID_ACCOUNT",
            _message(C.IND_MSG_INVALID_ACCOUNT, account_id=F.col("account_id").cast("string"))),
        hit(F.col("_prev_ts").isNotNull() & F.col("_within"), "RAPID_TRANSACTIONS", F.lit(C.IND_MSG_RAPID.format(seconds=cfg.rapid_seconds))),
        hit(F.col("balance_after") < 0, "NEGATIVE_BALANCE",
            _message(C.IND_MSG_NEGATIVE_BALANCE, balance_after=F.col("balance_after").cast("string"))),
        hit(F.col("_dup_rank") > 1, "DUPLICATE", F.lit(C.IND_MSG_DUPLICATE)),
        hit(_location_mismatch(strict_blank=False) & F.col("_known"), "LOCATION_MISMATCH",
            _message(C.IND_MSG_LOCATION, state=F.col("state"), home_state=F.col("home_state"))),
    ))
    return (f.select("transaction_id", "account_id", F.explode(hits).alias("_h"))
            .select("transaction_id", "account_id", "_h.anomaly_type", "_h.severity", "_h.description"))


def single_rule(raw: DataFrame, accounts: DataFrame, customers: DataFrame, rule: str,
                cfg: RuleConfig = DEFAULT_RULES, keep: Keep = as_is) -> DataFrame:
    """One independent rule alone: (transaction_id, account_id) of the rows that break it.

    Only the rapid rule needs the ordered windows; copies need the aggregate on their key, the
    others a filter (and the account lookup).
    """
    ids = ["transaction_id", "account_id"]
    if rule == "HIGH_AMOUNT":
        return raw.where(F.col("amount") > F.lit(cfg.high_amount)).select(*ids)
    if rule == "NEGATIVE_BALANCE":
        return raw.where(F.col("balance_after") < 0).select(*ids)
    if rule == "DUPLICATE":
        groups = (raw.groupBy(*COPY_KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("transaction_id").alias("_first_id"))
                  .where(F.col("_n") > 1).select(*[F.col(k).alias(f"_g_{k}") for k in COPY_KEY], "_first_id"))
        same = [raw[k].eqNullSafe(groups[f"_g_{k}"]) for k in COPY_KEY]
        return raw.join(groups, same).where(F.col("transaction_id") != F.col("_first_id")).select(*ids)
    if rule == "RAPID_TRANSACTIONS":
        f = rule_features(raw, accounts, customers, cfg, copy_lag=True, keep=keep)
        return f.where(F.col("_prev_ts").isNotNull() & F.col("_within")).select(*ids)
    j = with_home_states(raw, raw, accounts, customers, keep)
    broken = {"INVALID_ACCOUNT": F.col("_known").isNull(), "LOCATION_MISMATCH": _location_mismatch(strict_blank=False) & F.col("_known")}[rule]
    return j.where(F.coalesce(broken, F.lit(False))).select(*ids)


# ---------------------------------------------------------------- Q3 / Q4 / Q5

def anomalies(tagged: DataFrame, run_ts: _dt.datetime | None = None) -> DataFrame:
    """Q3: quarantined rows. ``anomaly_id`` is a deterministic hash, not a global counter: two
    tagged rows with one transaction id and type share it, so anomalies are counted by row."""
    detected = F.lit(run_ts or _dt.datetime(2000, 1, 1)).cast("timestamp_ntz")
    return tagged.where(F.col("anomaly_type").isNotNull()).select(
        F.xxhash64("transaction_id", "anomaly_type").alias("anomaly_id"),
        "transaction_id", "account_id", "anomaly_type", "severity",
        detected.alias("detected_at"), "description")


def clean(tagged: DataFrame, ids_unique: bool = False, keep: Keep = as_is) -> DataFrame:
    """Q4: the clean ledger (14 columns).

    A transaction id tagged on any row removes all rows with that id. When
    ids are known to be unique (C1) the row filter alone is exact; otherwise
    the tagged ids that untagged rows have too are anti-joined. They are found on
    the id alone and are few, as most tagged ids are on tagged rows only; ``keep``
    may store both sets of ids, so that what is few is broadcast (``broadcast_few``)
    and whole rows are not moved.
    """
    ok = tagged.where(F.col("anomaly_type").isNull())
    if not ids_unique:
        bad = keep("tagged_ids", tagged.where(F.col("anomaly_type").isNotNull()).select("transaction_id").distinct())
        mixed = keep("mixed_ids", ok.select("transaction_id").join(bad, "transaction_id", "left_semi").distinct())
        ok = ok.join(mixed, "transaction_id", "left_anti")
    return ok.select(*TRANSACTION_COLUMNS)


def run_metrics(tagged: DataFrame, ledger: DataFrame | None = None,
                started_at: _dt.datetime | None = None, completed_at: _dt.datetime | None = None,
                run_id: int = 1) -> DataFrame:
    """Q5: one validation-run record. The counts come from one aggregate over a
    union of the tagged rows and the clean ledger (no cross join)."""
    ledger = ledger if ledger is not None else clean(tagged)
    parts = tagged.select(F.lit(1).alias("_src"), F.col("anomaly_type").isNotNull().cast("int").alias("_anom"),
                          F.lit(0).alias("_valid")).unionByName(
        ledger.select(F.lit(0).alias("_src"), F.lit(0).alias("_anom"), F.lit(1).alias("_valid")))
    agg = parts.agg(F.sum("_src").cast("long").alias("source_record_count"),
                    F.sum("_valid").cast("long").alias("valid_record_count"),
                    F.sum("_anom").cast("long").alias("anomaly_count"))
    started = F.lit(started_at or _dt.datetime(2000, 1, 1)).cast("timestamp_ntz")
    completed = F.lit(completed_at or started_at or _dt.datetime(2000, 1, 1)).cast("timestamp_ntz")
    src = F.col("source_record_count")
    score = F.round(F.col("valid_record_count").cast("decimal(20,0)") * 100 / F.nullif(src, F.lit(0)), 4)
    return agg.where(src > 0).select(
        F.lit(run_id).cast("long").alias("run_id"),
        started.alias("run_started_at"), completed.alias("run_completed_at"),
        "source_record_count", "valid_record_count",
        (src - F.col("valid_record_count")).alias("invalid_record_count"),
        "anomaly_count", score.cast("decimal(7,4)").alias("dq_score"), F.lit("SUCCESS").alias("status"))


# ---------------------------------------------------------------- Q6-Q10

def breakdown(anomalies_df: DataFrame, by_severity: bool = False) -> DataFrame:
    """Q6 / Q7: anomaly count per type (and severity), most frequent first."""
    keys = ["anomaly_type", "severity"] if by_severity else ["anomaly_type"]
    return (anomalies_df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), *keys))


def latest_run(runs: DataFrame) -> DataFrame:
    """Q8: the newest run record."""
    return runs.orderBy(F.desc("run_started_at"), F.desc("run_id")).limit(1)


def recent(anomalies_df: DataFrame, n: int = 100) -> DataFrame:
    """Q9: newest ``n`` anomalies; ties broken by transaction id and type."""
    return anomalies_df.orderBy(F.desc("detected_at"), "transaction_id", "anomaly_type").limit(n)


def compare_truth(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """Q10: planted vs detected (transaction_id, anomaly_type) per type.

    Full outer join on both keys, then one aggregate per type.
    """
    d = detected.select("transaction_id", "anomaly_type", F.lit(True).alias("_d"))
    t = truth.select("transaction_id", "anomaly_type", F.lit(True).alias("_t"))
    j = d.join(t, ["transaction_id", "anomaly_type"], "full_outer")
    return j.groupBy("anomaly_type").agg(
        F.count_if(F.col("_t").isNotNull()).alias("planted"),
        F.count_if(F.col("_d").isNotNull()).alias("detected"),
        F.count_if(F.col("_t").isNotNull() & F.col("_d").isNotNull()).alias("matched"),
        F.count_if(F.col("_t").isNotNull() & F.col("_d").isNull()).alias("missed"),
        F.count_if(F.col("_t").isNull() & F.col("_d").isNotNull()).alias("unexpected"),
    )


def planted_truth(raw: DataFrame, cfg: RuleConfig = DEFAULT_RULES) -> DataFrame:
    """Expected first-match tags of the planted fixture rows, from the planting
    conditions alone (independent of the detection code)."""
    k = F.col("transaction_id") % 1000000000
    expected = F.coalesce(
        F.when((k % 250 == 4) & (F.col("amount") > cfg.high_amount), F.lit("HIGH_AMOUNT")),
        F.when(k % 500 == 7, F.lit("INVALID_ACCOUNT")),
        F.when(k % 450 == 3, F.lit("NEGATIVE_BALANCE")),
        F.when(k % 400 == 2, F.lit("DUPLICATE")),
        F.when(k % 400 == 1, F.lit("RAPID_TRANSACTIONS")),
        F.when((k % 300 == 5) & is_physical("channel"), F.lit("LOCATION_MISMATCH")),
    )
    return raw.select("transaction_id", expected.alias("anomaly_type")).where(F.col("anomaly_type").isNotNull())
