"""Star model: normalisation and dimension/fact building (SRC4, K4-K7).

The wide input is cleaned first (K1-K3 on its numeric and text columns, as the
star tables are built from the cleaned frame), then projected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import age_band
from ..schemas import STAR_CSV_COLUMNS
from .cleaning import clean_columns, numeric_columns, text_columns

FACT_COLUMNS = list(STAR_CSV_COLUMNS.values())


def normalise_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """SRC4: wide CSV names -> snake_case star names (unmapped columns kept)."""
    mapping = STAR_CSV_COLUMNS if mapping is None else mapping
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def clean_wide(wide: DataFrame) -> DataFrame:
    """Numeric columns: median + IQR clip; text columns: mode. Timestamps stay as they are:
    they arrive typed here, while a reader of untyped text would give null dates the mode."""
    return clean_columns(wide, numeric_columns(wide), text_columns(wide))


def build_dim_customers(wide: DataFrame) -> DataFrame:
    """K4 + K5: distinct (customer, age, occupation) with an age band.

    A customer whose attributes vary yields several rows (C1 flags them).
    """
    return (wide.select(F.col("AccountID").alias("customer_id"), F.col("CustomerAge").cast("int").alias("age"),
                        F.col("CustomerOccupation").alias("occupation")).distinct()
            .withColumn("segment", age_band("age")))


def build_dim_merchants(wide: DataFrame) -> DataFrame:
    """K6: distinct (merchant, location); the location is kept as ``merchant_category``."""
    return wide.select(F.col("MerchantID").alias("merchant_id"),
                       F.col("Location").alias("merchant_category")).distinct()


def build_fact(wide: DataFrame) -> DataFrame:
    """K7: the 14-column fact projection."""
    n = normalise_columns(wide)
    return n.select(*FACT_COLUMNS).withColumns({
        "transaction_duration": F.col("transaction_duration").cast("int"),
        "login_attempts": F.col("login_attempts").cast("int"),
    })
