"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import scratch_path

#: Rows and bytes of one Arrow batch that goes to a Python worker; texts can be long.
BATCH_ROWS, BATCH_BYTES = 256, "16m"


def by_value(module: str) -> None:
    """Ship the functions of `module` to the Python workers by value: executors need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker: few rows, and few bytes, in a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder of spark.checkpoint.dir and read it back.

    Lineage is cut there: what follows survives the loss of any executor, and
    values that depend on the run (salts) are fixed.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def random_salt(salts: int) -> Column:
    """A salt for each row, to be fixed by stored(): splits keys of any weight, null keys too."""
    return F.floor(F.rand() * salts).cast("int")


def attach_groups(rows: DataFrame, key: str, salt: str, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Give every row the aggregates of its `key`, however many rows share a key.

    `rows` has a fixed `salt`. Rows are aggregated by (key, salt) on the map side
    first, then by key over at most `salts` rows a key, and the results go back by
    (key, salt): no task gets all rows of a key. Null is a key like any other.
    `partial` aggregates rows; `final` aggregates the columns that `partial` made.
    """
    parts = rows.groupBy(key, salt).agg(*(c.alias(n) for n, c in partial.items()))
    totals = parts.groupBy(F.col(key).alias("_key")).agg(*(c.alias(n) for n, c in final.items()))
    slices = parts.select(F.col(key).alias("_slice"), F.col(salt).alias("_salt"))
    answers = slices.join(totals, F.col("_slice").eqNullSafe(F.col("_key"))).drop("_key")
    return rows.join(answers, F.col(key).eqNullSafe(F.col("_slice")) & (F.col(salt) == F.col("_salt"))).drop("_slice", "_salt")


by_value(__name__)
