"""Star-model analytics and ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SEARCH_COLUMNS, SORTABLE_COLUMNS, STAR_CREDIT_TYPE
from ..functions.columns import avg_exact, exact_sum, money_exact, month_label, month_start, text_match
from .paging import page_by_rank
from .rolling import rolling_range, rolling_rows

AMOUNT = "transaction_amount"
DATE = "transaction_date"


def monthly_spend_by_segment(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """A1: (month start, age band, total spent). The rows are summed by customer and month
    before the join, so a customer with many rows is one row a month there.

    The sum is an exact decimal sum of the amounts at micro-unit precision, so
    the monthly series (and the z-scores on it) do not depend on summation order.
    """
    per_customer = fact.groupBy("customer_id", month_start(DATE).alias("month")).agg(exact_sum(AMOUNT).alias("_t"))
    j = per_customer.join(dim.select("customer_id", "segment"), "customer_id")
    return j.groupBy("month", "segment").agg(F.sum("_t").alias("total_spent_exact")) \
        .withColumn("total_spent", F.col("total_spent_exact").cast("double"))


def rolling_rate(fact: DataFrame, rows: int = 7, parts: int | None = None) -> DataFrame:
    """A2: share (%) of ``Credit`` rows among this row and the ``rows - 1`` before it,
    by (date, id). Distributed over ranges of that order (see ``rolling``)."""
    r = rolling_rows(fact.select("transaction_id", DATE, "transaction_type"), [DATE, "transaction_id"],
                     {"credit": (F.col("transaction_type") == STAR_CREDIT_TYPE).cast("long")}, rows - 1, parts)
    return r.select("transaction_id", DATE,
                    (F.lit(100.0) * F.col("_sum_credit") / F.col("_rows")).alias("fraud_rate_percent"))


def rolling_rate_range(fact: DataFrame, days: int = 6, parts: int | None = None) -> DataFrame:
    """A2 in event time: share (%) of ``Credit`` rows among the rows of up to ``days`` days before each row, and at its time."""
    r = rolling_range(fact.select("transaction_id", DATE, "transaction_type"), DATE,
                      {"credit": (F.col("transaction_type") == STAR_CREDIT_TYPE).cast("long")}, days * 86_400, parts)
    return r.select("transaction_id", DATE, (F.lit(100.0) * F.col("_sum_credit") / F.col("_rows")).alias("rate_percent"))


def rolling_rate_daily(fact: DataFrame, days: int = 7) -> DataFrame:
    """A3: per day, the credit share over the last ``days`` calendar days.

    One row per day goes into the ordered window, so the single window
    partition holds at most one row per calendar day.
    """
    daily = fact.groupBy(F.to_date(DATE).alias("day")).agg(
        F.count_if(F.col("transaction_type") == STAR_CREDIT_TYPE).alias("credits"),
        F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.select("day", (F.lit(100.0) * F.sum("credits").over(w) / F.sum("n").over(w)).alias("rate_percent"))


def latest_rows_rate(fact: DataFrame, rows: int = 7) -> DataFrame:
    """The newest ``rows`` rows (top-k, not a global window)."""
    return fact.orderBy(F.desc(DATE), F.desc("transaction_id")).limit(rows).agg(
        (F.lit(100.0) * F.count_if(F.col("transaction_type") == STAR_CREDIT_TYPE) / F.count(F.lit(1)))
        .alias("fraud_rate_percent"))


def kpi_latest_month(spark: SparkSession, fact: DataFrame, rows: int = 7) -> DataFrame:
    """A4: newest month's total and average, plus the latest rolling rate; 0.0 when empty."""
    newest = (fact.groupBy(month_start(DATE).alias("m"))
              .agg(exact_sum(AMOUNT).alias("_s"), F.count(AMOUNT).alias("_n"))
              .orderBy(F.desc("m")).limit(1)
              .select("m", money_exact("_s").alias("s"), avg_exact("_s", "_n").alias("a")))
    rate = latest_rows_rate(fact, rows)
    return spark.range(1).select(
        F.date_format(newest.select("m").scalar(), "yyyy-MM").alias("month"),
        F.coalesce(newest.select("s").scalar(), F.lit(0.0)).alias("total_spend"),
        F.coalesce(newest.select("a").scalar(), F.lit(0.0)).alias("avg_transaction_amount"),
        F.round(F.coalesce(rate.scalar(), F.lit(0.0)), 2).alias("fraud_rate_percent"),
    )


def channel_distribution(fact: DataFrame) -> DataFrame:
    """A5."""
    return (fact.groupBy("channel").agg(F.count(F.lit(1)).alias("count"), exact_sum(AMOUNT).alias("_t"))
            .select("channel", "count", money_exact("_t").alias("total_amount"))
            .orderBy(F.desc("count"), "channel"))


def channel_share(distribution: DataFrame) -> DataFrame:
    """Share of count in %, one digit (global window over the few channel rows)."""
    total = F.sum("count").over(Window.partitionBy())
    return distribution.withColumn("share_pct", F.round(F.lit(100.0) * F.col("count") / total, 1))


def monthly_volume(fact: DataFrame) -> DataFrame:
    """A7."""
    return (fact.groupBy(month_label(DATE).alias("month"))
            .agg(F.count(F.lit(1)).alias("txn_count"), exact_sum(AMOUNT).alias("_t"), F.count(AMOUNT).alias("_n"))
            .select("month", "txn_count", money_exact("_t").alias("total_spend"), avg_exact("_t", "_n").alias("avg_amount"))
            .orderBy("month"))


def total_volume(monthly: DataFrame, flagged: DataFrame) -> DataFrame:
    """Sum of monthly counts and number of flagged trend rows."""
    return monthly.agg(F.sum("txn_count").cast("long").alias("total_transactions")).select(
        "total_transactions", flagged.select(F.count(F.lit(1))).scalar().alias("flagged_count"))


def top_locations(fact: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` locations by count (ties: location)."""
    return (fact.groupBy("location").agg(F.count(F.lit(1)).alias("txn_count"), exact_sum(AMOUNT).alias("_t"))
            .select("location", "txn_count", money_exact("_t").alias("total_amount"))
            .orderBy(F.desc("txn_count"), "location").limit(n))


def location_intensity(top: DataFrame) -> DataFrame:
    """A10: count relative to the largest of the (few) rows, whole percent."""
    return top.withColumn("intensity_pct", F.round(
        F.lit(100.0) * F.col("txn_count") / F.max("txn_count").over(Window.partitionBy()), 0).cast("long"))


def segment_overview(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Per age band; the average age is weighted by transactions. Summed by customer before the join."""
    per_customer = fact.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("_c"), exact_sum(AMOUNT).alias("_s"), F.count(AMOUNT).alias("_a"))
    j = per_customer.join(dim.select("customer_id", "segment", "age"), "customer_id")
    return (j.groupBy("segment").agg(F.sum("_c").alias("txn_count"), F.sum("_s").alias("_t"), F.sum("_a").alias("_n"),
                                     F.sum(F.col("age") * F.col("_c")).alias("_g"),
                                     F.sum(F.when(F.col("age").isNotNull(), F.col("_c"))).alias("_gn"))
            .select("segment", "txn_count", money_exact("_t").alias("total_spend"),
                    avg_exact("_t", "_n").alias("avg_amount"), avg_exact("_g", "_gn", 1, 1).alias("avg_age"))
            .orderBy(F.desc("total_spend"), "segment"))


class UnknownSegment(LookupError):
    pass


def segment_history(fact: DataFrame, dim: DataFrame, segment: str, require_rows: bool = False) -> DataFrame:
    """Monthly spend of one band. ``require_rows`` raises for an unknown band
    (one small ``isEmpty`` job), like the 404 of the reference endpoint."""
    h = (monthly_spend_by_segment(fact, dim).where(F.col("segment") == F.lit(segment))
         .select(month_label("month").alias("month"), money_exact("total_spent_exact").alias("total_spent"))
         .orderBy("month"))
    if require_rows and h.isEmpty():
        raise UnknownSegment(f"Segment '{segment}' not found")
    return h


PAGE_COLUMNS = ["transaction_id", "customer_id", "merchant_id", AMOUNT, DATE, "transaction_type", "location",
                "channel", "account_balance", "login_attempts"]


def _page_filter(fact: DataFrame, search: str, channel: str | None) -> DataFrame:
    df = fact
    if search:
        df = df.where(text_match(SEARCH_COLUMNS, search))
    if channel:
        df = df.where(F.col("channel") == F.lit(channel))
    return df


def transaction_page(fact: DataFrame, search: str = "", page: int = 1, per_page: int = 15,
                     sort_by: str = DATE, sort_dir: str = "desc", channel: str | None = None,
                     after: tuple | None = None) -> DataFrame:
    """One page of matching rows. Sort key is whitelisted (fallback: date
    desc), ties broken by id. ``after=(value, id)`` gives the keyset form for deep pages
    (a filter instead of an offset)."""
    if sort_by not in SORTABLE_COLUMNS:
        sort_by = DATE
    if sort_dir not in ("asc", "desc"):
        sort_dir = "desc"
    page = max(1, int(page))
    per_page = min(100, max(5, int(per_page)))
    df = _page_filter(fact, search, channel)
    key = F.col(sort_by)
    if after is not None:
        later = F.col("transaction_id") > F.lit(after[1])
        if after[0] is None:  # nulls come last (desc) or first (asc)
            beyond = key.isNull() & later if sort_dir == "desc" else key.isNotNull() | later
        else:
            v = F.lit(after[0])
            beyond = ((key == v) & later) | ((key < v) | key.isNull() if sort_dir == "desc" else key > v)
        df = df.where(beyond)
    ordered = df.orderBy(key.desc_nulls_last() if sort_dir == "desc" else key.asc_nulls_first(),
                         F.col("transaction_id"))
    if after is None and page > 1:
        ordered = ordered.offset((page - 1) * per_page)
    return ordered.limit(per_page).select(*PAGE_COLUMNS)


def transaction_page_deep(fact: DataFrame, search: str = "", page: int = 1, per_page: int = 15, sort_by: str = DATE,
                          sort_dir: str = "desc", channel: str | None = None) -> DataFrame:
    """A13 / A14 for pages of any depth: the rows of ``transaction_page``, found by counting ranks (``paging``),
    not by an offset whose rows all go to one task."""
    sort_by = sort_by if sort_by in SORTABLE_COLUMNS else DATE
    per_page = min(100, max(5, int(per_page)))
    df = _page_filter(fact, search, channel)
    return page_by_rank(df, sort_by, "transaction_id", sort_dir != "asc", (max(1, int(page)) - 1) * per_page, per_page).select(*PAGE_COLUMNS)


def page_info(fact: DataFrame, search: str = "", per_page: int = 15, channel: str | None = None,
              page: int = 1) -> DataFrame:
    """Total matching rows and number of pages (>= 1)."""
    per_page = min(100, max(5, int(per_page)))
    total = F.count(F.lit(1))
    return _page_filter(fact, search, channel).agg(total.alias("total")).select(
        "total", F.lit(max(1, int(page))).alias("page"), F.lit(per_page).alias("per_page"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(per_page))).cast("long").alias("total_pages"))


def high_login_flag(fact: DataFrame) -> DataFrame:
    """A15."""
    return fact.select("transaction_id", "login_attempts", (F.col("login_attempts") > 1).alias("high_login"))
