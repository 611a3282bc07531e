"""Table sources (SRC1-SRC6).

Tables live as Parquet directories ``<root>/<layer>/<name>``. Reads always use
the declared schema when one exists (no inference pass, stable types);
selected columns are pruned into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import schemas


def table_path(root: str, layer: str | None, name: str) -> str:
    parts = [root.rstrip("/")] + ([layer.strip("/")] if layer else []) + [name]
    return "/".join(parts)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, layer: str, name: str, columns: list[str] | None = None,
               missing_ok: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """SRC1 / SRC2 / SRC6: scan a stored table, optionally a column subset.

    ``missing_ok`` turns a missing table into an empty frame of the declared
    schema (the dashboard's "not built yet" case).
    """
    schema = schema or schemas.TABLES.get(name)
    path = table_path(root, layer, name)
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.parquet(path)
        if schema is None:
            df.schema  # resolve now so a missing path raises here
    except AnalysisException:
        if not missing_ok or schema is None:
            raise
        df = empty_table(spark, schema)
    return df.select(*columns) if columns else df


def table_exists(spark: SparkSession, root: str | None, layer: str, name: str) -> bool:
    """SRC6: is the table there: a Parquet directory below ``root``, or (``root`` None) a catalog table ``layer.name``?"""
    if root is None:
        return spark.catalog.tableExists(f"{layer}.{name}" if layer else name)
    try:
        spark.read.parquet(table_path(root, layer, name)).schema
        return True
    except AnalysisException:
        return False


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """SRC3: delimited file with a header. With a schema there is no inference pass."""
    reader = spark.read.option("header", header).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def to_raw_schema(df: DataFrame, schema: T.StructType = schemas.TRANSACTIONS,
                  defaults: dict[str, object] | None = None) -> DataFrame:
    """SRC5: cast text columns to the declared types with ``try_cast`` (ANSI mode
    would fail the job on one bad value) and apply column defaults.

    Adds ``_malformed``: the columns whose non-null text did not cast.
    """
    defaults = defaults or {}
    casts, bad = [], []
    for f in schema.fields:
        if f.name not in df.columns:
            casts.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
            continue
        src = F.col(f.name)
        typed = F.trim(src.cast("string")).try_cast(f.dataType) if f.dataType != T.StringType() else src
        bad.append(F.when(src.isNotNull() & typed.isNull(), F.lit(f.name)))
        if f.name in defaults:
            typed = F.coalesce(typed, F.lit(defaults[f.name]).cast(f.dataType))
        casts.append(typed.alias(f.name))
    return df.select(*casts, F.array_compact(F.array(*bad)).alias("_malformed") if bad
                     else F.array().cast("array<string>").alias("_malformed"))


def malformed_counts(typed: DataFrame) -> DataFrame:
    """Rows per malformed column (from ``to_raw_schema``)."""
    return (typed.select(F.explode("_malformed").alias("column_name"))
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("malformed_rows")))
