"""Column cleaning (K1-K3): median imputation, IQR clipping, mode imputation.

Statistics are a few numbers for each column, computed with aggregates in jobs
that cover all columns at once, and applied as literals: no join is needed.

* K1 / K2: quantiles are exact with linear interpolation (as pandas) and never
  hold a list of values (``exact_quantiles``): a sketch of all columns in one pass
  bounds each wanted rank by an interval of values, a second pass makes it exact.
* K3: the mode is a distributed ``groupBy(value).count()`` followed by a
  ``min_by`` on (-count, value): the lowest value wins a tie, as in pandas.
  Its memory does not grow with the number of distinct values.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import any_of
from ..session import scratch_path

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


#: KLL sketches: their size, and how far (of all rows) a quantile may lie from its rank; a wider miss is noticed and costs one more pass.
SKETCH_K, SKETCH_ERROR = 2000, 0.004
#: Value counts that are brought to the driver at once; beyond it an interval is cut further on the cluster.
FEW = 20_000


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], bins: int = FEW) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns (pandas ``quantile``), exact.

    One job sketches all columns (mergeable KLL sketches) and gives every wanted rank an
    interval of values. One more counts, for all intervals at once, the rows below each
    and its distinct values, so the answer is exact. If the intervals hold more than ``bins``
    distinct values these are stored with their counts in ranges of the value and a third job
    reads the range with the rank. Memory never grows with the data; ties cost nothing.
    Nulls and NaN are left out.
    """
    if not cols:
        return {}
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    points = sorted({q for p in probs for q in (max(0.0, p - SKETCH_ERROR), min(1.0, p + SKETCH_ERROR))})
    sketches = df.agg(*[a.alias(f"{n}{i}") for i, c in enumerate(cols) for n, a in (
        ("n", F.count(x[c])), ("lo", F.min(x[c])), ("hi", F.max(x[c])), ("s", F.kll_sketch_agg_double(x[c], SKETCH_K)))])
    read = [F.when(F.col(f"n{i}") > 0, F.array(*[F.kll_sketch_get_quantile_double(f"s{i}", F.lit(q)) for q in points])).alias(f"q{i}") for i in range(len(cols))]
    first = sketches.select("*", *read).drop(*[f"s{i}" for i in range(len(cols))]).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    wanted: list[tuple[str, int, int]] = []  # column, the ranks around a quantile
    intervals: list[tuple[str, float, float]] = []
    for i, c in enumerate(cols):
        for p in probs if counts[c] else []:
            low, high = _ranks(p, counts[c])
            lo, hi = (dict(zip(points, first[f"q{i}"]))[q] for q in (max(0.0, p - SKETCH_ERROR), min(1.0, p + SKETCH_ERROR)))
            # few rows: the sketch is exact but for the ranks' rounding, so take its neighbours' place by the ends
            exact_ends = counts[c] * SKETCH_ERROR < 2
            wanted.append((c, low, high))
            intervals.append((c, first[f"lo{i}"] if exact_ends or p <= SKETCH_ERROR else lo, first[f"hi{i}"] if exact_ends or p >= 1 - SKETCH_ERROR else hi))
    found = _at_ranks(df, x, wanted, intervals, bins, sum(2 * SKETCH_ERROR * counts[c] + 2 if counts[c] * SKETCH_ERROR >= 2 else counts[c] for c, _, _ in wanted))
    missed = [k for k, v in found.items() if v is None]
    if missed:  # a sketch was further off than it should be: the whole range of values holds the rank
        ends = {c: (first[f"lo{i}"], first[f"hi{i}"]) for i, c in enumerate(cols)}
        again = _at_ranks(df, x, [wanted[k] for k in missed], [(wanted[k][0], *ends[wanted[k][0]]) for k in missed], bins, sum(counts[wanted[k][0]] for k in missed))
        found.update({missed[j]: v for j, v in again.items()})
    answers = iter(found[k] for k in range(len(wanted)))
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = counts[c]
        out[c] = [_between(*next(answers), p * (n - 1) - int(p * (n - 1))) if n else None for p in probs]
    return out


def _at_ranks(df: DataFrame, x: dict[str, Column], wanted: list[tuple[str, int, int]],
              intervals: list[tuple[str, float, float]], bins: int, expected: float) -> dict[int, tuple[float, float] | None]:
    """For each wanted (column, low rank, high rank) the values there; None if its interval does not hold both.

    ``expected``: rows in all intervals; distinct values are no more, and are brought to the driver if they are at most ``bins``.
    """
    if not wanted:
        return {}
    # rows below an interval are counted under a null value
    parts = F.array_compact(F.array(*[
        F.when(x[c] <= hi, F.struct(F.lit(k).alias("k"), F.when(x[c] >= lo, x[c]).alias("x"))) for k, (c, lo, hi) in enumerate(intervals)]))
    per_value = df.select(F.explode(parts).alias("v")).groupBy("v.k", "v.x").agg(F.count(F.lit(1)).alias("n"))
    if expected <= bins:
        return _picked(per_value.collect(), wanted)
    spark = df.sparkSession
    parts_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "quillstone", f"quantiles-{uuid.uuid4().hex}")
    per_value.write.parquet(f"{path}/values")
    values_of = spark.read.schema(per_value.schema).parquet(f"{path}/values")
    if values_of.count() <= bins:
        return _picked(values_of.collect(), wanted)
    dealt = values_of.repartitionByRange(parts_n, F.col("k"), F.col("x").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(f"{path}/ranges")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/ranges")
    totals: dict[int, list] = {}
    for r in stored.groupBy("k", "part").agg(F.sum("n").alias("n")).orderBy("k", "part").collect():
        totals.setdefault(r["k"], []).append((r["part"], r["n"]))
    # (interval, part, rank, rank within the part)
    places = []
    for k, (_, low, high) in enumerate(wanted):
        below = 0
        for part, n in totals.get(k, []):
            places += [(k, part, rank, rank - below) for rank in {low, high} if below <= rank < below + n]
            below += n
    upto = F.sum("n").over(Window.partitionBy("k", "part").orderBy(F.col("x").asc_nulls_first()))
    hit = any_of([(F.col("k") == k) & (F.col("part") == part) for k, part, _, _ in places])
    here = any_of([(F.col("k") == k) & (F.col("part") == part) & (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at) for k, part, _, at in places])
    rows = stored.where(hit).withColumn("upto", upto).where(here).collect()
    values = {(k, rank): r["x"] for k, part, rank, at in places for r in rows if (r["k"], r["part"]) == (k, part) and r["upto"] - r["n"] <= at < r["upto"]}
    got = lambda k, rank: values.get((k, rank))
    return {k: (got(k, low), got(k, high)) if got(k, low) is not None and got(k, high) is not None else None for k, (_, low, high) in enumerate(wanted)}


def _picked(rows: list, wanted: list[tuple[str, int, int]]) -> dict[int, tuple[float, float] | None]:
    by_interval: dict[int, list] = {}
    for r in rows:
        by_interval.setdefault(r["k"], []).append((r["x"] is not None, r["x"] if r["x"] is not None else 0.0, r["n"]))
    out: dict[int, tuple[float, float] | None] = {}
    for k, (_, low, high) in enumerate(wanted):
        below, values = 0, {}
        for known, value, n in sorted(by_interval.get(k, [])):
            for rank in (low, high):
                if known and below <= rank < below + n:
                    values[rank] = value
            below += n
        out[k] = (values[low], values[high]) if low in values and high in values else None
    return out


def _between(lo: float, hi: float, share: float) -> float:
    if not share or lo == hi:
        return lo
    return lo + (hi - lo) * share if math.isfinite(hi - lo) else lo * (1 - share) + hi * share


def _ranks(p: float, n: int) -> tuple[int, int]:
    low = int(p * (n - 1))
    return low, min(low + 1, n - 1)


def columns_with_nulls(df: DataFrame, cols: list[str]) -> list[str]:
    """The columns that hold at least one null (one small aggregate job)."""
    if not cols:
        return []
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def impute_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """K1: nulls in each column -> the column median.

    Every listed column is cast to double, as a pandas fill makes it float;
    medians are only computed for columns that actually hold nulls.
    """
    cols = numeric_columns(df) if cols is None else cols
    todo = columns_with_nulls(df, cols)
    if not todo:
        return df.withColumns({c: F.col(c).cast("double") for c in cols})
    med = exact_quantiles(df, todo, [0.5])
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c][0]).cast("double")) if c in todo
            else F.col(c).cast("double") for c in cols}
    return df.withColumns(fill)


def clip_iqr(df: DataFrame, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """K2: clip to [Q1 - k IQR, Q3 + k IQR]; quartiles of the given (already imputed) frame.
    Values are replaced, no row is dropped."""
    cols = numeric_columns(df) if cols is None else cols
    qs = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            out[c] = F.col(c).cast("double")
            continue
        iqr = q3 - q1
        lo, hi = F.lit(q1 - k * iqr).cast("double"), F.lit(q3 + k * iqr).cast("double")
        out[c] = F.least(F.greatest(F.col(c).cast("double"), lo), hi)
    return df.withColumns(out)


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column (ties -> lowest), as (column_name, mode) rows."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("_kv")).select("_kv.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def impute_mode(df: DataFrame, cols: list[str] | None = None, missing: str = "UNKNOWN") -> DataFrame:
    """K3: nulls -> most frequent value (lowest on ties); an all-null column -> ``missing``."""
    cols = text_columns(df) if cols is None else cols
    todo = columns_with_nulls(df, cols)
    if not todo:
        return df
    modes = {r["column_name"]: r["mode"] for r in column_modes(df, todo).collect()}  # one row a column
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c, missing))) for c in todo})


def clean_columns(df: DataFrame, numeric: list[str] | None = None, text: list[str] | None = None) -> DataFrame:
    """K1 + K2 + K3 in this order: impute, then clip (of the imputed values), then modes."""
    numeric = numeric_columns(df) if numeric is None else numeric
    text = text_columns(df) if text is None else text
    out = impute_median(df, numeric) if numeric else df
    out = clip_iqr(out, numeric) if numeric else out
    return impute_mode(out, text) if text else out
