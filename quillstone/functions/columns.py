"""Column expressions (filters F1-F6 and scalar expressions E1-E10).

All are plain ``pyspark.sql.functions`` compositions, so they stay inside
whole-stage codegen and push down where the scan allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    AFFLUENT_INCOME, AGE_BAND_ELSE, AGE_BANDS, INFLOW_TYPE, MACHINE_EPSILON, OUTFLOW_TYPES,
    PHYSICAL_CHANNELS, PREMIUM_INCOME, SEGMENT_DEFAULT_AGE, SEGMENT_DEFAULT_INCOME, SENIOR_AGE,
    STATUS_SUCCESS, STUDENT_AGE, STUDENT_INCOME,
)


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- filters

def succeeded(status: str | Column = "status") -> Column:
    """status = 'SUCCESS'."""
    return col_or(status) == F.lit(STATUS_SUCCESS)


def is_outflow(tx_type: str | Column = "transaction_type") -> Column:
    """DEBIT, WITHDRAWAL or PAYMENT (TRANSFER is neither in- nor outflow)."""
    return col_or(tx_type).isin(*OUTFLOW_TYPES)


def is_inflow(tx_type: str | Column = "transaction_type") -> Column:
    return col_or(tx_type) == F.lit(INFLOW_TYPE)


def is_physical(channel: str | Column = "channel") -> Column:
    """ATM or BRANCH."""
    return col_or(channel).isin(*PHYSICAL_CHANNELS)


def is_missing(c: str | Column) -> Column:
    """IS NULL."""
    return col_or(c).isNull()


def equals(c: str | Column, value) -> Column:
    """equality with a bound value (never string-built SQL)."""
    return col_or(c) == F.lit(value)


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def text_match(columns: list[str], query: str) -> Column:
    """case-insensitive literal substring search OR-ed over columns.

    A null column never matches; ``%`` and ``_`` are ordinary characters.
    """
    q = F.lower(F.lit(query))
    return any_of([F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in columns])


# ---------------------------------------------------------------- expressions

def debit_amount(amount: str = "amount", tx_type: str = "transaction_type") -> Column:
    """Amount when outflow else 0."""
    return F.when(is_outflow(tx_type), F.col(amount)).otherwise(F.lit(0))


def credit_amount(amount: str = "amount", tx_type: str = "transaction_type") -> Column:
    return F.when(is_inflow(tx_type), F.col(amount)).otherwise(F.lit(0))


def net_amount(amount: str = "amount", tx_type: str = "transaction_type") -> Column:
    """Credit adds, everything else (TRANSFER included) subtracts."""
    return F.when(is_inflow(tx_type), F.col(amount)).otherwise(-F.col(amount))


def zero_if_null(c: str | Column) -> Column:
    """E2."""
    return F.coalesce(col_or(c), F.lit(0))


def money(c: str | Column, digits: int = 2) -> Column:
    """Money rounded half-up to ``digits``; it stays a decimal, so sums of it are exact."""
    return F.round(col_or(c).cast("decimal(38,6)"), digits)


MICRO = "decimal(20,6)"


def exact_sum(c: str | Column) -> Column:
    """Exact sum of money held as doubles (amounts have at most 6 decimals)."""
    return F.sum(col_or(c).cast(MICRO))


def money_exact(c: str | Column, digits: int = 2) -> Column:
    """A decimal rounded half-up (away from zero) to ``digits``, as a double."""
    return F.round(col_or(c), digits).cast("double")


def money_dec(c: str | Column) -> Column:
    """A double money value rounded half-up to cents through its decimal value."""
    return money_exact(col_or(c).cast(MICRO))


def avg_exact(total: str, n: str, scale: int = 6, digits: int = 2) -> Column:
    """Exact ``total / n`` rounded half-up (away from zero) to ``digits``.

    ``total`` is a sum with at most ``scale`` decimals. Integer division on
    ``total * 10^scale``, so the result does not depend on binary rounding.
    Null when ``n`` is 0.
    """
    unit = 10 ** scale
    div = 10 ** (scale - digits)
    return F.expr(
        f"CAST(CASE WHEN {total} < 0 THEN -1 ELSE 1 END * "
        f"((abs(CAST({total} * {unit} AS DECIMAL(38,0))) * 2 + {n} * {div}) div (nullif({n}, 0) * {2 * div}))"
        f" AS DOUBLE) / {10 ** digits}.0")


def avg_money(total: str, n: str) -> Column:
    """Exact average of a money sum (2 decimals) over a count, half-up to cents."""
    return avg_exact(total, n, 2, 2)


def day_of(ts: str | Column) -> Column:
    """Calendar day."""
    return F.to_date(col_or(ts))


def month_start(ts: str | Column) -> Column:
    """First instant of the month, as timestamp_ntz (``date_trunc`` alone returns a
    session-zone timestamp, which clients outside UTC would read shifted)."""
    return F.date_trunc("month", col_or(ts)).cast("timestamp_ntz")


def month_label(ts: str | Column) -> Column:
    """E4: 'yyyy-MM'."""
    return F.date_format(col_or(ts), "yyyy-MM")


def seconds_between(earlier: str | Column, later: str | Column) -> Column:
    """E5: elapsed seconds with microsecond fraction (no whole-second truncation)."""
    return F.timestamp_diff("MICROSECOND", col_or(earlier), col_or(later)) / F.lit(1_000_000.0)


def format_money(c: str | Column) -> Column:
    """Thousands separators and two decimals."""
    return F.format_number(col_or(c).cast("decimal(20,2)"), 2)


def upper_norm(c: str | Column) -> Column:
    """E7."""
    return F.upper(F.coalesce(col_or(c).cast("string"), F.lit("")))


def display_amount(c: str | Column) -> Column:
    """E9: '<v/1e7> Cr' above 1e7, else the whole amount, with separators."""
    v = col_or(c).cast("double")
    return F.when(v > 1e7, F.concat(F.format_number(v / 1e7, 2), F.lit(" Cr"))).otherwise(F.format_number(v, 0))


def display_month(ts: str | Column) -> Column:
    """E9: 'MMM yyyy'."""
    return F.date_format(col_or(ts), "MMM yyyy")


def safe_std(sd: Column) -> Column:
    """Zero standard deviation becomes machine epsilon (ANSI division stays safe)."""
    return F.when(sd == 0, F.lit(MACHINE_EPSILON)).otherwise(sd)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add a column with a literal default only when the column is absent."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


# ---------------------------------------------------------------- classifications

def segment_of(age: str | Column = "age", income: str | Column = "annual_income",
               customer_type: str | Column = "customer_type") -> Column:
    """G1 rule chain; a null age or income fails its comparisons and falls through."""
    a, inc, t = col_or(age), col_or(income), upper_norm(customer_type)
    return (
        F.when(a >= SENIOR_AGE, "SENIOR")
        .when((a < STUDENT_AGE) & (inc < STUDENT_INCOME), "STUDENT")
        .when((inc >= PREMIUM_INCOME) | (t == "HIGH_NET_WORTH"), "PREMIUM")
        .when(inc >= AFFLUENT_INCOME, "AFFLUENT")
        .when(t == "BUSINESS", "SMALL_BUSINESS")
        .when(t == "SALARIED", "SALARIED")
        .otherwise("MASS_MARKET")
    )


SEGMENT_DEFAULTS = {"age": SEGMENT_DEFAULT_AGE, "annual_income": SEGMENT_DEFAULT_INCOME, "customer_type": ""}


def age_band(age: str | Column = "age") -> Column:
    """K5: Young < 30, Mid < 55, else Senior (null age -> Senior)."""
    a = col_or(age)
    out = None
    for name, upper in AGE_BANDS:
        out = F.when(a < upper, name) if out is None else out.when(a < upper, name)
    return out.otherwise(AGE_BAND_ELSE)
