"""Registered queries: one per operator key of the inventory.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver's tables (through the derived ledger). Output columns are aliased to
the names used by the DuckDB oracle in ``checks/oracle_sql.py``; money is a
double rounded to cents, counts are longs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import analytics as A
from ..operators import constraints as CK
from ..operators import dashboard as D
from ..operators import joins as J
from ..operators import key_index as KI
from ..operators import partials as P
from ..operators import postings as NG
from ..operators import quality as Q
from ..operators import trends as T
from ..operators import views as V
from ..config import RuleConfig
from ..operators.cleaning import clip_iqr, impute_median, impute_mode
from ..operators.segments import segment_breakdown, segment_customers
from ..operators.star import normalise_columns
from ..schemas import BRANCHES, TRANSACTION_COLUMNS
from ..session import scratch_path
from ..sinks.commits import publish, read_runs, run_log
from ..sinks.tables import RunResult, export_csv, write_table
from ..sources.fixtures import CLEANING_NUMERIC, CLEANING_TEXT, driver_table
from ..sources.tables import read_csv, read_table, table_exists, to_raw_schema
from .context import Ledger, session_ledger
from .reports import executive_brief, report_manifest, risk_tiering, write_reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _decimals_as_double(df: DataFrame) -> DataFrame:
    """Results leave as doubles where the engine keeps decimals (exact for money and
    scores, and compared the same way by every client)."""
    from pyspark.sql import types as T
    dec = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in dec}) if dec else df


def query(key: str):
    def deco(fn):
        def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _decimals_as_double(fn(spark, sf_dir))
        registered.__name__ = key
        registered.__doc__ = fn.__doc__
        QUERIES[key] = registered
        return fn
    return deco


def L(spark: SparkSession, sf_dir: str) -> Ledger:
    """The session's materialized ledger for ``sf_dir`` (built on first use)."""
    return session_ledger(spark, sf_dir)


# ============================================================ sources (SRC)

@query("scan_table")
def _scan_table(spark, sf):
    return read_table(spark, sf, "", "customer.parquet")


@query("scan_columns")
def _scan_columns(spark, sf):
    return read_table(spark, sf, "", "orders.parquet", columns=["o_orderkey", "o_totalprice"])


@query("scan_csv")
def _scan_csv(spark, sf):
    path = scratch_path(spark, "csv", f"branches-{uuid.uuid4().hex}")
    L(spark, sf).branches.write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path, schema=BRANCHES)


@query("normalise_columns")
def _normalise(spark, sf):
    return normalise_columns(L(spark, sf).fx.star_wide())


def _raw_text(led: Ledger) -> DataFrame:
    """Raw transactions as text, with a planted unparsable amount on fixed rows."""
    r = led.raw
    cols = {c: F.col(c).cast("string") for c in TRANSACTION_COLUMNS}
    cols["amount"] = F.when(F.col("transaction_id") % 997 == 5, F.lit("n/a")).otherwise(F.col("amount").cast("string"))
    cols["status"] = F.when(F.col("transaction_id") % 991 == 3, F.lit(None)).otherwise(F.col("status"))
    return r.select(*[v.alias(k) for k, v in cols.items()])


@query("typed_raw")
def _typed_raw(spark, sf):
    t = to_raw_schema(_raw_text(L(spark, sf)), defaults={"status": "SUCCESS"})
    return t.select("transaction_id", "amount", "status", "login_attempts", "transaction_timestamp",
                    F.concat_ws(",", "_malformed").alias("malformed"))


@query("relation_exists")
def _relation_exists(spark, sf):
    parts = []
    for name in ["orders", "customer", "no_such_table"]:
        present = table_exists(spark, sf, "", f"{name}.parquet")
        if present:
            df = read_table(spark, sf, "", f"{name}.parquet").agg(F.count(F.lit(1)).alias("row_count"))
        else:
            df = read_table(spark, sf, "", f"{name}.parquet", missing_ok=True, schema=BRANCHES) \
                .agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(df.select(F.lit(name).alias("table_name"), F.lit(present).alias("present"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ============================================================ filters (F)

@query("filter_success")
def _f1(spark, sf):
    return L(spark, sf).raw.where(X.succeeded()).select("transaction_id", "channel", "amount")


@query("filter_in")
def _f2(spark, sf):
    return L(spark, sf).raw.where(X.is_outflow() & X.is_physical()).select(
        "transaction_id", "transaction_type", "channel")


@query("filter_null")
def _f3(spark, sf):
    return L(spark, sf).raw.where(X.is_missing("merchant_id")).select("transaction_id", "channel")


@query("multi_filter")
def _f4(spark, sf):
    return D.filter_transactions(L(spark, sf).tx, channel="UPI", state="S3", tx_type="ALL", limit=500)


@query("text_search")
def _f5(spark, sf):
    return L(spark, sf).fact.where(X.text_match(C.SEARCH_COLUMNS, "nation_1")).select(
        "transaction_id", "location", "channel")


@query("text_search_indexed")
def _f5i(spark, sf):
    fact = L(spark, sf).fact
    root = _once(spark, sf, "postings", lambda root: NG.build(fact, "transaction_id", C.SEARCH_COLUMNS, root))
    return NG.search(fact, "transaction_id", C.SEARCH_COLUMNS, root, "nation_1").select("transaction_id", "location", "channel")


@query("equality_param")
def _f6(spark, sf):
    return L(spark, sf).raw.where(X.equals("channel", "POS")).select("transaction_id", "channel", "amount")


# ============================================================ expressions (E)

@query("conditional_agg")
def _e1(spark, sf):
    tx = L(spark, sf).tx
    return tx.groupBy("channel").agg(
        X.money(F.sum(X.debit_amount())).alias("total_debit"),
        X.money(F.sum(X.credit_amount())).alias("total_credit"),
        F.count_if(F.col("status") != "SUCCESS").alias("failed"))


@query("coalesce_zero")
def _e2(spark, sf):
    led = L(spark, sf)
    s = V.account_stats(led.tx)
    return led.accounts.select("account_id").join(s, "account_id", "left").select(
        "account_id", X.zero_if_null("n_ok").alias("n_ok"), X.money(X.zero_if_null("value_ok")).alias("value_ok"))


@query("round_to")
def _e3(spark, sf):
    """Half-up rounding of exact money values (the SQL views round NUMERIC)."""
    x = F.col("amount") * F.lit(0.37).cast("decimal(3,2)")
    return L(spark, sf).raw.select("transaction_id", F.round(x, 1).alias("r1"), F.round(x, 2).alias("r2"),
                                   F.round(x, 0).alias("r0"))


@query("day_of")
def _e4(spark, sf):
    ts = "transaction_timestamp"
    return L(spark, sf).raw.select("transaction_id", X.day_of(ts).alias("day"), X.month_start(ts).alias("month_start"),
                                   X.month_label(ts).alias("month_label"))


@query("seconds_between")
def _e5(spark, sf):
    r = J.with_previous(L(spark, sf).raw, ["account_id"], ["transaction_timestamp", "transaction_id"],
                        ["transaction_timestamp"], bucket=F.date_trunc("day", "transaction_timestamp"))
    return r.select("transaction_id", "prev_transaction_timestamp",
                    X.seconds_between("prev_transaction_timestamp", "transaction_timestamp").alias("seconds"))


@query("describe_anomaly")
def _e6(spark, sf):
    return L(spark, sf).raw.select("transaction_id", X.format_money("amount").alias("amount_text"),
                                   X.format_money("balance_after").alias("balance_text"))


@query("upper_norm")
def _e7(spark, sf):
    return L(spark, sf).customers.select("customer_id", X.upper_norm("customer_type").alias("customer_type_norm"))


@query("abs")
def _e8(spark, sf):
    return L(spark, sf).raw.select("transaction_id", F.abs("balance_after").alias("abs_balance"))


@query("display_scale")
def _e9(spark, sf):
    tx = L(spark, sf).tx
    per = tx.groupBy("channel", X.month_start("transaction_timestamp").alias("m")).agg(F.sum("amount").alias("v"))
    return per.select("channel", X.display_month("m").alias("month_display"),
                      X.display_amount("v").alias("value_display"))


@query("column_default")
def _e10(spark, sf):
    c = L(spark, sf).customers.drop("annual_income")
    return segment_customers(c).select("customer_id", "segment")


# ============================================================ joins (J)

@query("join_inner")
def _j1(spark, sf):
    led = L(spark, sf)
    return J.join_inner(led.tx.select("transaction_id", "account_id"),
                        led.accounts.select("account_id", "account_type"), "account_id")


@query("join_left_cond")
def _j2(spark, sf):
    led = L(spark, sf)
    return J.left_join_where(led.merchants.select("merchant_id"),
                             led.tx.select("merchant_id", "transaction_id", "status"),
                             "merchant_id", X.succeeded()).select("merchant_id", "transaction_id")


@query("join_left")
def _j3(spark, sf):
    led = L(spark, sf)
    return J.join_left(led.customers.select("customer_id"), (led.segments.select("customer_id", "segment"), "customer_id"),
                       (led.accounts.select("customer_id", "account_id"), "customer_id"))


@query("join_anti")
def _j4(spark, sf):
    led = L(spark, sf)
    return J.orphans(led.raw.select("transaction_id", "account_id"), led.accounts, "account_id")


@query("join_semi")
def _j5(spark, sf):
    led = L(spark, sf)
    return J.keep_ids(led.raw.select("transaction_id", "amount"), led.anomalies, "transaction_id")


@query("join_lookup")
def _j6(spark, sf):
    led = L(spark, sf)
    return Q.home_states(led.accounts, led.customers).select("account_id", "home_state")


@query("adjacent_row")
def _j7(spark, sf):
    r = J.with_previous(L(spark, sf).raw, ["account_id"], ["transaction_timestamp", "transaction_id"],
                        ["transaction_timestamp", "amount"], bucket=F.date_trunc("day", "transaction_timestamp"))
    return r.select("transaction_id", "prev_transaction_timestamp", "prev_amount")


# ============================================================ quality (Q)

_ANOM_COLS = ["transaction_id", "account_id", "anomaly_type", "severity", "description"]


@query("dq_all_rules")
def _q1(spark, sf):
    led = L(spark, sf)
    return Q.independent_anomalies(led.raw, led.accounts, led.customers, keep=led.marks_new)


@query("dq_first_match")
def _q2(spark, sf):
    return L(spark, sf).tagged.select(*_ANOM_COLS)


def _single(rule):
    def fn(spark, sf):
        led = L(spark, sf)
        return Q.single_rule(led.raw, led.accounts, led.customers, rule, keep=led.marks_new)
    return fn


for _key, _rule in {"dq_high_amount": "HIGH_AMOUNT", "dq_invalid_account": "INVALID_ACCOUNT", "dq_negative_balance": "NEGATIVE_BALANCE",
                    "dq_duplicate": "DUPLICATE", "dq_rapid": "RAPID_TRANSACTIONS", "dq_location": "LOCATION_MISMATCH"}.items():
    query(_key)(_single(_rule))


@query("dq_anomalies")
def _q3(spark, sf):
    return L(spark, sf).anomalies.drop("anomaly_id")


@query("dq_core_transactions")
def _q4(spark, sf):
    return L(spark, sf).tx


@query("dq_score")
def _q5(spark, sf):
    return L(spark, sf).runs


@query("dq_breakdown")
def _q6(spark, sf):
    return Q.breakdown(L(spark, sf).anomalies)


@query("dq_breakdown_severity")
def _q7(spark, sf):
    return Q.breakdown(L(spark, sf).anomalies, by_severity=True)


@query("dq_latest_run")
def _q8(spark, sf):
    """Over three published runs, the last two begun at the same time."""
    first = L(spark, sf).runs
    later = [first.withColumns({"run_id": F.lit(i).cast("long"), "run_started_at": F.col("run_started_at") + F.expr("INTERVAL 1 DAY")})
             for i in (2, 3)]
    return Q.latest_run(first.unionByName(later[0]).unionByName(later[1]))


@query("dq_recent_anomalies")
def _q9(spark, sf):
    return Q.recent(L(spark, sf).anomalies.drop("anomaly_id"), 100)


@query("dq_truth_compare")
def _q10(spark, sf):
    led = L(spark, sf)
    return Q.compare_truth(led.anomalies, Q.planted_truth(led.raw))


# ============================================================ constraints (C)

@query("check_unique")
def _c1(spark, sf):
    return CK.check_unique(L(spark, sf).raw, ["account_id", "transaction_timestamp", "amount", "transaction_type"])


def _thirds(df: DataFrame) -> list[tuple[str, DataFrame]]:
    return [(f"b{i}", df.where(F.pmod("transaction_id", F.lit(3)) == i)) for i in range(3)]


@query("check_unique_batches")
def _c1b(spark, sf):
    raw = L(spark, sf).raw
    index = KI.KeyIndex(spark, scratch_path(spark, "quillstone", f"key-index-{uuid.uuid4().hex}"),
                        ["account_id", "transaction_timestamp", "amount", "transaction_type"], buckets=8)
    return KI.unique_over_batches(index, _thirds(raw))


@query("check_foreign_key_batches")
def _c3b(spark, sf):
    led = L(spark, sf)
    index = KI.KeyIndex(spark, scratch_path(spark, "quillstone", f"key-index-{uuid.uuid4().hex}"), ["account_id"], buckets=8)
    for i in range(2):
        index.add(led.accounts.where(F.pmod("account_id", F.lit(2)) == i), f"p{i}")
    return index.missing(led.raw).select("transaction_id", "account_id")


@query("check_not_null")
def _c2(spark, sf):
    return CK.check_not_null(L(spark, sf).raw, TRANSACTION_COLUMNS)


@query("check_foreign_key")
def _c3(spark, sf):
    led = L(spark, sf)
    return CK.check_foreign_key(led.raw.select("transaction_id", "account_id"), led.accounts, "account_id")


@query("check_domain")
def _c4(spark, sf):
    """Customer types outside the four that hold accounts of their own (STUDENT is planted)."""
    return CK.domain_profile(L(spark, sf).customers, "customer_type", ["BUSINESS", "HIGH_NET_WORTH", "RETAIL", "SALARIED"])


@query("check_range")
def _c5(spark, sf):
    """On the raw rows, where violations are planted."""
    return CK.check_range(L(spark, sf).raw, {
        "amount_positive": F.col("amount") > 0,
        "balance_not_negative": F.col("balance_after") >= 0,
        "amount_within_threshold": F.col("amount") <= C.HIGH_AMOUNT_THRESHOLD,
    })


@query("check_unassigned")
def _c6(spark, sf):
    """Some customers are left out of the segments, some have a null segment (planted)."""
    led = L(spark, sf)
    key = F.col("customer_id")
    segments = led.segments.where(key % 17 != 3).withColumn("segment", F.when(key % 13 != 5, F.col("segment")))
    return CK.check_unassigned(led.customers.select("customer_id"), segments)


# ============================================================ cleaning, star (K)

_CLEAN_OUT = ["l_orderkey", "l_linenumber"]


def _r6(cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


@query("impute_median")
def _k1(spark, sf):
    d = impute_median(L(spark, sf).cleaning_input, CLEANING_NUMERIC)
    return d.select(*_CLEAN_OUT, *_r6(CLEANING_NUMERIC))


@query("clip_iqr")
def _k2(spark, sf):
    d = clip_iqr(impute_median(L(spark, sf).cleaning_input, CLEANING_NUMERIC), CLEANING_NUMERIC)
    return d.select(*_CLEAN_OUT, *_r6(CLEANING_NUMERIC))


@query("impute_mode")
def _k3(spark, sf):
    d = impute_mode(L(spark, sf).cleaning_input, CLEANING_TEXT)
    return d.select(*_CLEAN_OUT, *CLEANING_TEXT)


@query("dim_customers")
def _k4(spark, sf):
    return L(spark, sf).dim_customers


@query("age_band")
def _k5(spark, sf):
    return L(spark, sf).dim_customers.select("age", "segment").distinct()


@query("dim_merchants")
def _k6(spark, sf):
    return L(spark, sf).dim_merchants


@query("fact_transactions")
def _k7(spark, sf):
    f = L(spark, sf).fact
    return f.withColumns({"transaction_amount": X.money_dec("transaction_amount"),
                          "account_balance": X.money_dec("account_balance")})


# ============================================================ segments (G)

@query("customer_segments")
def _g1(spark, sf):
    return L(spark, sf).segments


@query("segment_breakdown")
def _g2(spark, sf):
    return segment_breakdown(L(spark, sf).segments)


# ============================================================ views (V)

@query("v_daily_transaction_summary")
def _v1(spark, sf):
    return V.daily_summary(L(spark, sf).tx)


@query("v_monthly_transaction_summary")
def _v2(spark, sf):
    return V.monthly_summary(L(spark, sf).tx)


@query("v_branch_performance")
def _v3(spark, sf):
    led = L(spark, sf)
    return V.branch_performance(led.branches, led.accounts, led.tx)


@query("v_customer_segment_performance")
def _v4(spark, sf):
    led = L(spark, sf)
    return V.segment_performance(led.segments, led.customers, led.accounts, led.tx)


@query("v_merchant_category_performance")
def _v5(spark, sf):
    led = L(spark, sf)
    return V.merchant_category_performance(led.merchants, led.tx)


@query("v_channel_performance")
def _v6(spark, sf):
    return V.channel_performance(L(spark, sf).tx)


@query("v_debit_credit_summary")
def _v7(spark, sf):
    led = L(spark, sf)
    return V.debit_credit_summary(led.accounts, led.customers, led.tx)


@query("v_active_accounts_summary")
def _v8(spark, sf):
    return V.active_accounts_summary(L(spark, sf).accounts)


@query("v_top_customers")
def _v9(spark, sf):
    led = L(spark, sf)
    return V.top_customers(led.customers, led.segments, led.accounts, led.tx, 100)


@query("v_failed_transactions_summary")
def _v10(spark, sf):
    return V.failed_transactions_summary(L(spark, sf).tx)


@query("v_anomaly_summary")
def _v11(spark, sf):
    return V.anomaly_summary(L(spark, sf).anomalies)


@query("v_customer_risk_summary")
def _v12(spark, sf):
    led = L(spark, sf)
    return V.customer_risk_summary(led.customers, led.segments, led.accounts, led.tx, led.anomalies)


@query("v_grouping_sets")
def _v_sets(spark, sf):
    led = L(spark, sf)
    return V.grouped_summary(led.accounts, led.segments, led.tx)


def _published(spark, sf) -> str:
    """A root with three published runs, each a third of the days, the second in place of a run that had other rows;
    written once for each session and data directory."""
    return _once(spark, sf, "published", lambda root: _publish_thirds(spark, L(spark, sf), root))


def _once(spark, sf, name, write) -> str:
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _WRITTEN:
        root = scratch_path(spark, "quillstone", f"{name}-{uuid.uuid4().hex}")
        write(root)
        _WRITTEN[key] = root
    return _WRITTEN[key]


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _publish_thirds(spark, led: Ledger, root: str) -> None:
    def result(third, run_id):
        tx = led.tx.where(F.pmod(F.unix_date(F.to_date("transaction_timestamp")), F.lit(3)) == third)
        found = led.anomalies.where(F.pmod("transaction_id", F.lit(3)) == third)
        return RunResult(tx, found, led.runs.withColumn("run_id", F.lit(run_id).cast("long")))

    state, version = None, 0
    for run_id, third, replace in ((1, 0, False), (2, 2, False), (3, 2, False), (2, 1, True)):
        done = publish(spark, result(third, run_id), root, run_id, replace, files_per_month=1)
        P.keep_state(spark, done)
        state = P.state_at(spark, root) if state is None else P.advanced(spark, root, state, version)
        version = done.version
        state.write.parquet(f"{root}/merged/version={version}")
        state = spark.read.parquet(f"{root}/merged/version={version}")


def _merged_state(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{_published(spark, sf)}/merged/version=4")


@query("v_daily_incremental")
def _v1i(spark, sf):
    return P.daily_summary(_merged_state(spark, sf))


@query("v_monthly_incremental")
def _v2i(spark, sf):
    return P.monthly_summary(_merged_state(spark, sf))


@query("v_channel_incremental")
def _v6i(spark, sf):
    return P.channel_performance(_merged_state(spark, sf))


@query("v_failed_incremental")
def _v10i(spark, sf):
    return P.failed_transactions_summary(_merged_state(spark, sf))


@query("v_anomaly_incremental")
def _v11i(spark, sf):
    return P.anomaly_summary(spark, _published(spark, sf))


# ============================================================ sinks (SNK): written, and read back

@query("append_table")
def _snk1(spark, sf):
    root, raw = scratch_path(spark, "quillstone", f"append-{uuid.uuid4().hex}"), L(spark, sf).raw
    for part in (0, 1):
        write_table(raw.where(F.pmod("transaction_id", F.lit(2)) == part), root, "raw", "transactions")
    return read_table(spark, root, "raw", "transactions", columns=["transaction_id", "channel", "amount"])


@query("replace_table")
def _snk2(spark, sf):
    root, raw = scratch_path(spark, "quillstone", f"replace-{uuid.uuid4().hex}"), L(spark, sf).raw
    write_table(raw.where("channel = 'ATM'"), root, "raw", "transactions", mode="overwrite")
    write_table(raw.where("channel <> 'ATM'"), root, "raw", "transactions", mode="overwrite")
    return read_table(spark, root, "raw", "transactions", columns=["transaction_id", "channel", "amount"])


@query("publish_run")
def _snk3(spark, sf):
    return read_runs(spark, _published(spark, sf), "core/transactions").select(*TRANSACTION_COLUMNS)


@query("append_run_log")
def _snk4(spark, sf):
    return run_log(spark, _published(spark, sf)).drop("run_started_at", "run_completed_at")


@query("export_csv")
def _snk5(spark, sf):
    root, df = scratch_path(spark, "quillstone", f"csv-{uuid.uuid4().hex}"), L(spark, sf).customers
    export_csv(df, root)
    return read_csv(spark, root, schema=df.schema)


@query("report_bundle")
def _snk6(spark, sf):
    return spark.read.parquet(f"{_reports(spark, sf)}/*/_manifest")


def _reports(spark, sf) -> str:
    """The four reports, written once for each session and data directory."""
    return _once(spark, sf, "reports", lambda root: write_reports(spark, L(spark, sf), root))


def _sheet(report, sheet):
    def fn(spark, sf):
        return spark.read.parquet(f"{_reports(spark, sf)}/{report}/{sheet.replace(' ', '_')}").drop("anomaly_id")
    return fn


#: Key -> report and sheet: what was written, read back.
SHEETS = {
    "sheet_monthly_summary": ("report_monthly", "Monthly Summary"), "sheet_channel_breakdown": ("report_monthly", "Channel Breakdown"),
    "sheet_branch_overview": ("report_monthly", "Branch Overview"), "sheet_cohort_metrics": ("report_segments", "Cohort Metrics"),
    "sheet_risk_tiering": ("report_segments", "Risk Tiering"), "sheet_quarantined_records": ("report_anomalies", "Quarantined Records"),
    "sheet_summary_by_type": ("report_anomalies", "Summary by Type"), "sheet_validation_runs": ("report_data_quality", "Validation Runs"),
    "sheet_category_integrity": ("report_data_quality", "Category Integrity"),
}
for _key, _place in SHEETS.items():
    query(_key)(_sheet(*_place))


# ============================================================ star analytics (A)

def _a1(led: Ledger) -> DataFrame:
    return A.monthly_spend_by_segment(led.fact, led.dim_customers)


@query("monthly_spend_by_segment")
def _qa1(spark, sf):
    return _a1(L(spark, sf)).select("month", "segment", X.money_exact("total_spent_exact").alias("total_spent"))


@query("rolling_rate")
def _qa2(spark, sf):
    return A.rolling_rate(L(spark, sf).fact, 7)


@query("rolling_rate_range")
def _qa2r(spark, sf):
    return A.rolling_rate_range(L(spark, sf).fact, 6)


@query("rolling_rate_daily")
def _qa3(spark, sf):
    return A.rolling_rate_daily(L(spark, sf).fact, 7)


@query("kpi_latest_month")
def _qa4(spark, sf):
    return A.kpi_latest_month(spark, L(spark, sf).fact, 7)


@query("channel_distribution")
def _qa5(spark, sf):
    return A.channel_distribution(L(spark, sf).fact)


@query("channel_share")
def _qa6(spark, sf):
    return A.channel_share(A.channel_distribution(L(spark, sf).fact))


@query("monthly_volume")
def _qa7(spark, sf):
    return A.monthly_volume(L(spark, sf).fact)


@query("total_volume")
def _qa8(spark, sf):
    led = L(spark, sf)
    return A.total_volume(A.monthly_volume(led.fact), T.trend_flagged(T.spend_trend_prior(_a1(led))))


@query("top_locations")
def _qa9(spark, sf):
    return A.top_locations(L(spark, sf).fact, 10)


@query("location_intensity")
def _qa10(spark, sf):
    return A.location_intensity(A.top_locations(L(spark, sf).fact, 10))


@query("segment_overview")
def _qa11(spark, sf):
    led = L(spark, sf)
    return A.segment_overview(led.fact, led.dim_customers)


@query("segment_history")
def _qa12(spark, sf):
    led = L(spark, sf)
    return A.segment_history(led.fact, led.dim_customers, "Mid")


@query("transaction_page")
def _qa13(spark, sf):
    p = A.transaction_page(L(spark, sf).fact, search="NATION_1", page=2, per_page=15,
                           sort_by="transaction_amount", sort_dir="desc")
    return p.withColumns({"transaction_amount": X.money_dec("transaction_amount"),
                          "account_balance": X.money_dec("account_balance")})


@query("transaction_page_deep")
def _qa13d(spark, sf):
    """The page in the middle of the listing: its offset grows with the table."""
    fact = L(spark, sf).fact
    pages = A.page_info(fact, per_page=15).first()["total"] // 15
    p = A.transaction_page_deep(fact, page=pages // 2 + 1, per_page=15, sort_by="transaction_amount", sort_dir="desc")
    return p.withColumns({"transaction_amount": X.money_dec("transaction_amount"),
                          "account_balance": X.money_dec("account_balance")})


@query("transaction_page_info")
def _qa13b(spark, sf):
    return A.page_info(L(spark, sf).fact, search="NATION_1", per_page=15, page=2)


@query("channel_filter")
def _qa14(spark, sf):
    p = A.transaction_page(L(spark, sf).fact, search="", page=3, per_page=20, sort_by="account_balance",
                           sort_dir="asc", channel="ATM")
    return p.withColumns({"transaction_amount": X.money_dec("transaction_amount"),
                          "account_balance": X.money_dec("account_balance")})


@query("high_login_flag")
def _qa15(spark, sf):
    return A.high_login_flag(L(spark, sf).fact)


# ============================================================ trends (T)

def _trend_out(t: DataFrame) -> DataFrame:
    return t.select(X.month_label("month").alias("month"), "segment",
                    F.round("total_spent", 2).alias("total_spent"), F.round("rolling_mean", 4).alias("rolling_mean"),
                    F.round("rolling_std", 4).alias("rolling_std"), F.round("z_score", 4).alias("z_score"), "flag")


@query("spend_trend")
def _t1(spark, sf):
    return _trend_out(T.spend_trend(_a1(L(spark, sf))))


@query("spend_trend_prior")
def _t2(spark, sf):
    return _trend_out(T.spend_trend_prior(_a1(L(spark, sf))))


@query("trend_flagged")
def _t3(spark, sf):
    return T.trend_flagged(T.spend_trend(_a1(L(spark, sf))))


@query("trend_flagged_prior")
def _t3b(spark, sf):
    return T.trend_flagged(T.spend_trend_prior(_a1(L(spark, sf))))


@query("trend_ranked")
def _t4(spark, sf):
    return T.trend_ranked(T.spend_trend_prior(_a1(L(spark, sf))))


# ============================================================ dashboard (D)

@query("kpi_totals")
def _d1(spark, sf):
    led = L(spark, sf)
    return D.kpi_totals(led.tx, led.customers, led.anomalies)


@query("debit_credit_split")
def _d2(spark, sf):
    return D.debit_credit_split(V.monthly_summary(L(spark, sf).tx))


@query("distinct_values")
def _d3(spark, sf):
    return D.distinct_values(L(spark, sf).tx, "state")


@query("distinct_channels")
def _d3b(spark, sf):
    return D.distinct_values(L(spark, sf).tx, "channel")


@query("distinct_transaction_types")
def _d3c(spark, sf):
    return D.distinct_values(L(spark, sf).tx, "transaction_type")


@query("top_merchant_categories")
def _d4(spark, sf):
    led = L(spark, sf)
    return D.top_merchant_categories(V.merchant_category_performance(led.merchants, led.tx), 8)


# ============================================================ reports

@query("report_manifest")
def _r1(spark, sf):
    return report_manifest(L(spark, sf))


def _report(name):
    def fn(spark, sf):
        return report_manifest(L(spark, sf)).where(F.col("report") == F.lit(name)).select("sheet", "row_count")
    return fn


for _name in ["report_monthly", "report_segments", "report_anomalies", "report_data_quality"]:
    query(_name)(_report(_name))


@query("report_risk_tiering")
def _r2b(spark, sf):
    return risk_tiering(L(spark, sf))


@query("executive_brief")
def _r2(spark, sf):
    return executive_brief(spark, L(spark, sf))


# ============================================================ streaming (S)

def _stream_dirs(spark, name):
    base = scratch_path(spark, "stream", f"{name}-{uuid.uuid4().hex}")
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def _landed(spark, sf, name):
    """The stream input, landed once per session and data directory in 4 time-ordered
    slices (read-only, shared by the streaming queries); fresh output and checkpoint dirs."""
    from ..streaming.rules import read_transaction_stream
    _, out, ck = _stream_dirs(spark, name)
    return read_transaction_stream(spark, L(spark, sf).stream_landing), out, ck


@query("stream_row_rules")
def _s1(spark, sf):
    from ..streaming.rules import row_rule_stream, run_available_now
    led = L(spark, sf)
    stream, out, ck = _landed(spark, sf, "s1")
    run_available_now(row_rule_stream(stream, led.accounts, led.customers), out, ck)
    return spark.read.parquet(out)


@query("stream_first_match")
def _s2(spark, sf):
    from ..streaming.rules import first_match_stream, run_available_now
    led = L(spark, sf)
    stream, out, ck = _landed(spark, sf, "s2")
    run_available_now(first_match_stream(stream, led.accounts, led.customers, watermark="1 minute"), out, ck)
    return spark.read.parquet(out)


def _timed(spark, sf, name, landing):
    """S2 by buckets of thirty days and timers, over a landing; the landed rows and the decided ones."""
    from ..schemas import TRANSACTIONS
    from ..streaming.rules import read_transaction_stream, run_available_now
    from ..streaming.timers import first_match_by_timers, timer_store
    led = L(spark, sf)
    _, out, ck = _stream_dirs(spark, name)
    with timer_store(spark):
        run_available_now(first_match_by_timers(read_transaction_stream(spark, landing), led.accounts, led.customers, _MONTHS), out, ck)
    return spark.read.schema(TRANSACTIONS).parquet(landing), spark.read.parquet(out)


#: An account has a few rows a month: wide buckets, so that there are few keys.
_MONTHS = RuleConfig(bucket_seconds=30 * 86_400)


@query("stream_first_match_timers")
def _s2t(spark, sf):
    return _timed(spark, sf, "s2t", L(spark, sf).stream_landing)[1]


@query("stream_first_match_corrected")
def _s2c(spark, sf):
    """Over a landing in no order of time: what the stream decides, with the corrections for rows that came too late."""
    from ..streaming import timers
    led = L(spark, sf)
    landed, decided = _timed(spark, sf, "s2c", led.shuffled_landing)
    late = timers.missing_rows(landed, decided)
    return timers.corrected(decided, timers.corrections(landed, decided, late, led.accounts, led.customers, _MONTHS, led.stored_new))


@query("stream_channel_volume")
def _s3(spark, sf):
    from ..streaming.rules import channel_volume_stream, run_available_now
    stream, out, ck = _landed(spark, sf, "s3")
    run_available_now(channel_volume_stream(stream, "1 day", None, "1 hour"), out, ck)
    return spark.read.parquet(out)


@query("stream_channel_volume_sliding")
def _s3b(spark, sf):
    from ..streaming.rules import channel_volume_stream, run_available_now
    stream, out, ck = _landed(spark, sf, "s3b")
    run_available_now(channel_volume_stream(stream, "1 day", "12 hours", "1 hour"), out, ck)
    return spark.read.parquet(out)
