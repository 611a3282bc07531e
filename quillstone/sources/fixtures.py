"""Banking tables derived from the driver's TPC-H-like Parquet tables.

Every derived table is a fixed column expression over the driver tables,
so its size grows with them and the DuckDB oracle (``checks/oracle_sql.py``)
can rebuild it with the same rules. Keys stay integers.

Design notes for scale:
* one pass over ``orders``: the planted rapid / duplicate copies are made with
  ``explode`` of a per-row copy list, not by scanning ``orders`` three times;
* the order -> customer lookup is a plain equi join; Spark picks broadcast or
  sort-merge from the measured size (never forced).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import CHANNELS, TRANSACTION_TYPES

# FIXED VALUES of the fixture rules (documented in FIXTURES.md)
RAPID_COPY_OFFSET = 1000000000
DUPLICATE_COPY_OFFSET = 2000000000
SECOND_ACCOUNT_OFFSET = 10000000
STAR_CHANNELS = ["Online", "ATM", "Branch"]
FIXTURE_EPOCH = _dt.datetime(2020, 1, 1)

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _state(code: Column) -> Column:
    return F.concat(F.lit("S"), (code % 11).cast("string"))


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _money(c: Column) -> Column:
    return c.cast(schemas.MONEY)


# ---------------------------------------------------------------- masters

def branches(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "inner").select(
        F.col("n_nationkey").cast("int").alias("branch_id"),
        F.col("n_name").alias("branch_name"),
        F.col("n_name").alias("city"),
        _state(F.col("n_nationkey")).alias("state"),
        F.col("r_name").alias("region"),
        F.lit(FIXTURE_EPOCH).cast("timestamp_ntz").alias("created_at"),
    )


def merchants(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("merchant_id"),
        F.col("p_name").alias("merchant_name"),
        F.col("p_type").alias("merchant_category"),
        F.concat(F.lit("CITY_"), (F.col("p_partkey") % 25).cast("string")).alias("city"),
        _state(F.col("p_partkey")).alias("state"),
    )


def _customer_type(c: DataFrame) -> Column:
    seg, key = F.col("c_mktsegment"), F.col("c_custkey")
    return (
        F.when(seg == "BUILDING", "BUSINESS")
        .when(seg == "MACHINERY", "SALARIED")
        .when(seg == "HOUSEHOLD", F.when(key % 4 == 0, "HIGH_NET_WORTH").otherwise("SALARIED"))
        .when(seg == "FURNITURE", "RETAIL")
        .otherwise("STUDENT")
    )


def customers(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    age = (F.lit(18) + key % 61).cast("int")
    return customer.select(
        key.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.make_date((F.lit(2024) - age).cast("int"), (key % 12 + 1).cast("int"), (key % 28 + 1).cast("int"))
        .alias("date_of_birth"),
        age.alias("age"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.concat(F.lit("CITY_"), F.col("c_nationkey").cast("string")).alias("city"),
        _state(F.col("c_nationkey")).alias("state"),
        _customer_type(customer).alias("customer_type"),
        _money(F.lit(150000) + (key * 104729) % 3350000).alias("annual_income"),
        F.lit(FIXTURE_EPOCH).cast("timestamp_ntz").alias("created_at"),
    )


def accounts(customer: DataFrame) -> DataFrame:
    """Every customer has one account; even keys get a second one.

    Built with one scan and ``explode`` over the account slots.
    """
    key = F.col("c_custkey")
    slots = F.when(key % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", F.explode(slots).alias("_slot"))
    second = F.col("_slot") == 1
    return c.select(
        F.when(second, key + SECOND_ACCOUNT_OFFSET).otherwise(key).alias("account_id"),
        key.alias("customer_id"),
        F.when(second, "FIXED_DEPOSIT").when(key % 3 == 0, "CURRENT").otherwise("SAVINGS").alias("account_type"),
        F.date_add(F.lit("2015-01-01").cast("date"), (key % 3000).cast("int")).alias("account_open_date"),
        F.when(second, _money(F.col("c_acctbal")) * 2).otherwise(_money(F.col("c_acctbal")))
        .cast(schemas.MONEY).alias("current_balance"),
        F.when(second, (F.col("c_nationkey") + 7) % 25).otherwise(F.col("c_nationkey")).cast("int").alias("branch_id"),
        F.when(~second & (key % 25 == 0), "INACTIVE").otherwise("ACTIVE").alias("account_status"),
    )


# ---------------------------------------------------------------- transactions

def raw_transactions(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Raw transactions: one per order, plus planted rapid and duplicate copies."""
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    k = F.col("o_orderkey")
    copies = F.array_compact(F.array(
        F.lit(0),
        F.when(k % 400 == 1, F.lit(1)),
        F.when(k % 400 == 2, F.lit(2)),
    ))
    base = o.join(c, "o_custkey", "left").select("*", F.explode(copies).alias("_copy"))

    channel = _pick(CHANNELS, k % 6)
    price = _money(F.col("o_totalprice"))
    ts = F.timestamp_add("SECOND", (k * 7919) % 86400, F.col("o_orderdate"))
    copy = F.col("_copy")
    return base.select(
        (k + F.when(copy == 1, RAPID_COPY_OFFSET).when(copy == 2, DUPLICATE_COPY_OFFSET).otherwise(0))
        .alias("transaction_id"),
        F.when(k % 500 == 7, -k)
        .when((F.col("o_custkey") % 2 == 0) & (k % 3 == 0), F.col("o_custkey") + SECOND_ACCOUNT_OFFSET)
        .otherwise(F.col("o_custkey")).alias("account_id"),
        F.when(channel.isin("ATM", "BRANCH"), F.lit(None)).otherwise((k * 31) % 200).alias("merchant_id"),
        F.when(copy == 1, F.timestamp_add("SECOND", F.lit(3), ts)).otherwise(ts).alias("transaction_timestamp"),
        _pick(TRANSACTION_TYPES, k % 5).alias("transaction_type"),
        channel.alias("channel"),
        F.when(k % 250 == 4, price * 3).otherwise(price).cast(schemas.MONEY).alias("amount"),
        F.when(k % 450 == 3, -price).otherwise(price).cast(schemas.MONEY).alias("balance_after"),
        F.concat(F.lit("CITY_"), F.col("c_nationkey").cast("string")).alias("city"),
        F.when(k % 300 == 5, _state(F.col("c_nationkey") + 1)).otherwise(_state(F.col("c_nationkey"))).alias("state"),
        F.when(k % 67 == 0, "FAILED").otherwise("SUCCESS").alias("status"),
        F.concat(F.lit("DEV"), (k % 997).cast("string")).alias("device_id"),
        F.concat_ws(".", F.lit("10"), (k % 256).cast("string"), (F.col("o_custkey") % 256).cast("string"),
                    F.lit("1")).alias("ip_address"),
        F.when(k % 50 == 0, 2).otherwise(1).cast("int").alias("login_attempts"),
    )


# ---------------------------------------------------------------- star model input

def star_wide(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """The wide star-model input with the CSV column names (SRC4 normalises it)."""
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment")
    n = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k = F.col("o_orderkey")
    ts = F.timestamp_add("SECOND", (k * 7919) % 86400, F.col("o_orderdate"))
    w = o.join(c, "o_custkey", "left").join(n, "c_nationkey", "left")
    return w.select(
        k.cast("string").alias("TransactionID"),
        F.col("o_custkey").cast("string").alias("AccountID"),
        F.when(k % 53 != 9, F.col("o_totalprice").cast("double")).alias("TransactionAmount"),
        ts.alias("TransactionDate"),
        F.when(k % 4 == 0, "Credit").otherwise("Debit").alias("TransactionType"),
        F.when(k % 47 != 6, F.col("n_name")).alias("Location"),
        F.concat(F.lit("DEV"), (k % 997).cast("string")).alias("DeviceID"),
        F.concat_ws(".", F.lit("10"), (k % 256).cast("string"), (F.col("o_custkey") % 256).cast("string"),
                    F.lit("1")).alias("IP Address"),
        ((k * 31) % 200).cast("string").alias("MerchantID"),
        _pick(STAR_CHANNELS, k % 3).alias("Channel"),
        (F.lit(18) + F.col("o_custkey") % 61).cast("int").alias("CustomerAge"),
        F.col("c_mktsegment").alias("CustomerOccupation"),
        (F.lit(10) + k % 290).cast("int").alias("TransactionDuration"),
        (F.lit(1) + k % 3).cast("int").alias("LoginAttempts"),
        F.col("c_acctbal").cast("double").alias("AccountBalance"),
        F.timestamp_add("DAY", -(k % 30 + 1), F.col("o_orderdate")).alias("PreviousTransactionDate"),
    )


# ---------------------------------------------------------------- cleaning input

CLEANING_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLEANING_TEXT = ["l_returnflag", "l_linestatus"]


def cleaning_input(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` with nulls and outliers planted on fixed row conditions."""
    k = F.col("l_orderkey")
    ln = F.col("l_linenumber")
    far = {"l_quantity": k % 41 == 0, "l_extendedprice": k % 37 == 6}

    def planted(c: str, cond: Column) -> Column:
        value = F.when(far[c], F.col(c) * 30).otherwise(F.col(c)) if c in far else F.col(c)
        return F.when(cond, F.lit(None)).otherwise(value).alias(c)

    return lineitem.select(
        "l_orderkey", "l_linenumber",
        planted("l_quantity", k % 17 == 0),
        planted("l_extendedprice", (k + ln) % 23 == 5),
        planted("l_discount", k % 29 == 3),
        "l_tax",
        planted("l_returnflag", (k + ln) % 19 == 2),
        planted("l_linestatus", k % 31 == 4),
    )


# ---------------------------------------------------------------- stream input

def stream_input(events: DataFrame, customer: DataFrame) -> DataFrame:
    """Events as raw transactions (user = account), with planted rule hits.

    Planted: rapid copies (+2 s) and duplicate copies, unknown accounts,
    high amounts, negative balances and state shifts on ATM/BRANCH rows. The
    column set is the raw transaction schema, so the batch rules apply unchanged.
    """
    k = F.col("event_id")
    copies = F.array_compact(F.array(F.lit(0), F.when(k % 97 == 1, F.lit(1)), F.when(k % 97 == 2, F.lit(2))))
    c = customer.select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    e = events.select("event_id", "ts", "user_id", "event_type", "value", F.explode(copies).alias("_copy")) \
        .join(c, "user_id", "left")
    copy = F.col("_copy")
    channel = _pick(CHANNELS, k % 6)
    amount = _money(F.col("value") * 1000)
    return e.select(
        (k + F.when(copy == 1, RAPID_COPY_OFFSET).when(copy == 2, DUPLICATE_COPY_OFFSET).otherwise(0))
        .alias("transaction_id"),
        F.when(k % 89 == 7, -F.col("user_id") - 1).otherwise(F.col("user_id")).alias("account_id"),
        F.when(channel.isin("ATM", "BRANCH"), F.lit(None)).otherwise((k * 31) % 200).alias("merchant_id"),
        F.when(copy == 1, F.timestamp_add("SECOND", F.lit(2), F.col("ts"))).otherwise(F.col("ts"))
        .alias("transaction_timestamp"),
        _pick(TRANSACTION_TYPES, k % 5).alias("transaction_type"),
        channel.alias("channel"),
        F.when(k % 211 == 4, amount * 1000).otherwise(amount).cast(schemas.MONEY).alias("amount"),
        F.when(k % 113 == 3, -amount).otherwise(amount).cast(schemas.MONEY).alias("balance_after"),
        F.lit(None).cast("string").alias("city"),
        F.when(k % 83 == 5, _state(F.col("c_nationkey") + 1)).otherwise(_state(F.col("c_nationkey"))).alias("state"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        F.lit(None).cast("string").alias("device_id"),
        F.lit(None).cast("string").alias("ip_address"),
        F.lit(1).alias("login_attempts"),
    )


# ---------------------------------------------------------------- bundle

class Fixtures:
    """Lazily derived banking tables over one driver data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return driver_table(self.spark, self.sf_dir, name)

    def branches(self) -> DataFrame:
        return branches(self.table("nation"), self.table("region"))

    def merchants(self) -> DataFrame:
        return merchants(self.table("part"))

    def customers(self) -> DataFrame:
        return customers(self.table("customer"))

    def accounts(self) -> DataFrame:
        return accounts(self.table("customer"))

    def raw_transactions(self) -> DataFrame:
        return raw_transactions(self.table("orders"), self.table("customer"))

    def star_wide(self) -> DataFrame:
        return star_wide(self.table("orders"), self.table("customer"), self.table("nation"))

    def cleaning_input(self) -> DataFrame:
        return cleaning_input(self.table("lineitem"))

    def stream_input(self) -> DataFrame:
        return stream_input(self.table("events"), self.table("customer"))
