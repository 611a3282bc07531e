"""Declared schemas of the ledger model and the star model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
SCORE = T.DecimalType(7, 4)


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BRANCHES = _s(
    ("branch_id", T.IntegerType()), ("branch_name", T.StringType()), ("city", T.StringType()),
    ("state", T.StringType()), ("region", T.StringType()), ("created_at", T.TimestampNTZType()),
)

MERCHANTS = _s(
    ("merchant_id", T.LongType()), ("merchant_name", T.StringType()), ("merchant_category", T.StringType()),
    ("city", T.StringType()), ("state", T.StringType()),
)

CUSTOMERS = _s(
    ("customer_id", T.LongType()), ("customer_name", T.StringType()), ("date_of_birth", T.DateType()),
    ("age", T.IntegerType()), ("gender", T.StringType()), ("city", T.StringType()), ("state", T.StringType()),
    ("customer_type", T.StringType()), ("annual_income", MONEY), ("created_at", T.TimestampNTZType()),
)

ACCOUNTS = _s(
    ("account_id", T.LongType()), ("customer_id", T.LongType()), ("account_type", T.StringType()),
    ("account_open_date", T.DateType()), ("current_balance", MONEY), ("branch_id", T.IntegerType()),
    ("account_status", T.StringType()),
)

TRANSACTIONS = _s(
    ("transaction_id", T.LongType()), ("account_id", T.LongType()), ("merchant_id", T.LongType()),
    ("transaction_timestamp", T.TimestampNTZType()), ("transaction_type", T.StringType()),
    ("channel", T.StringType()), ("amount", MONEY), ("balance_after", MONEY), ("city", T.StringType()),
    ("state", T.StringType()), ("status", T.StringType()), ("device_id", T.StringType()),
    ("ip_address", T.StringType()), ("login_attempts", T.IntegerType()),
)
TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS.fields]

CUSTOMER_SEGMENTS = _s(
    ("customer_id", T.LongType()), ("segment", T.StringType()), ("assigned_at", T.TimestampNTZType()),
)

ANOMALIES = _s(
    ("anomaly_id", T.LongType()), ("transaction_id", T.LongType()), ("account_id", T.LongType()),
    ("anomaly_type", T.StringType()), ("severity", T.StringType()), ("detected_at", T.TimestampNTZType()),
    ("description", T.StringType()),
)

VALIDATION_RUNS = _s(
    ("run_id", T.LongType()), ("run_started_at", T.TimestampNTZType()), ("run_completed_at", T.TimestampNTZType()),
    ("source_record_count", T.LongType()), ("valid_record_count", T.LongType()),
    ("invalid_record_count", T.LongType()), ("anomaly_count", T.LongType()), ("dq_score", SCORE),
    ("status", T.StringType()),
)

# star model
DIM_CUSTOMERS = _s(("customer_id", T.StringType()), ("age", T.IntegerType()), ("occupation", T.StringType()),
                   ("segment", T.StringType()))
DIM_MERCHANTS = _s(("merchant_id", T.StringType()), ("merchant_category", T.StringType()))
FACT_TRANSACTIONS = _s(
    ("transaction_id", T.StringType()), ("customer_id", T.StringType()), ("merchant_id", T.StringType()),
    ("transaction_amount", T.DoubleType()), ("transaction_date", T.TimestampNTZType()),
    ("transaction_type", T.StringType()), ("location", T.StringType()), ("device_id", T.StringType()),
    ("ip_address", T.StringType()), ("channel", T.StringType()), ("transaction_duration", T.IntegerType()),
    ("login_attempts", T.IntegerType()), ("account_balance", T.DoubleType()),
    ("previous_transaction_date", T.TimestampNTZType()),
)

# wide CSV names -> star names (SRC4)
STAR_CSV_COLUMNS = {
    "TransactionID": "transaction_id", "AccountID": "customer_id", "MerchantID": "merchant_id",
    "TransactionAmount": "transaction_amount", "TransactionDate": "transaction_date",
    "TransactionType": "transaction_type", "Location": "location", "DeviceID": "device_id",
    "IP Address": "ip_address", "Channel": "channel", "TransactionDuration": "transaction_duration",
    "LoginAttempts": "login_attempts", "AccountBalance": "account_balance",
    "PreviousTransactionDate": "previous_transaction_date",
}

TABLES = {
    "branches": BRANCHES, "merchants": MERCHANTS, "customers": CUSTOMERS, "accounts": ACCOUNTS,
    "raw_transactions": TRANSACTIONS, "core_transactions": TRANSACTIONS,
    "customer_segments": CUSTOMER_SEGMENTS, "anomalies": ANOMALIES, "validation_runs": VALIDATION_RUNS,
    "dim_customers": DIM_CUSTOMERS, "dim_merchants": DIM_MERCHANTS, "fact_transactions": FACT_TRANSACTIONS,
}
