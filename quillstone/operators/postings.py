"""F5 by postings of trigrams.

``build`` writes, for every row and searched column, the distinct trigrams of the lower-cased
value (with a mark before and after it), as (gram, column, row id), partitioned by a hash of
the gram, and how many rows each gram has. ``search`` reads only the partitions of the query's
rarest grams, intersects their rows, and checks the literal match on the candidates alone.
A query shorter than three letters has no gram of its own: its candidates are the rows of
all grams that contain it (every occurrence lies in one). The result is that of ``text_match``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import text_match

N = 3
#: Marks the ends of a value; a query that holds it is searched by a scan.
EDGE = "\x1f"
#: So many of a query's grams, the rarest, are intersected; the literal check does the rest.
RAREST = 4


def grams_of(value: Column) -> Column:
    """Distinct trigrams of a value between its marks."""
    marked = F.concat(F.lit(EDGE), F.lower(value), F.lit(EDGE))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (N - 1), F.lit(1))), lambda i: F.substr(marked, i, F.lit(N)))
    return F.array_distinct(each)


def grams_in(query: str) -> list[str]:
    q = query.lower()
    return sorted({q[i:i + N] for i in range(len(q) - N + 1)})


def build(df: DataFrame, row_id: str, columns: list[str], root: str, buckets: int = 64) -> str:
    """Write the postings of ``columns`` below ``root``; null values have none."""
    def placed(i: int):
        return lambda g: F.struct(g.alias("gram"), F.lit(i).alias("col"))

    parts = [F.when(F.col(c).isNotNull(), F.transform(grams_of(F.col(c).cast("string")), placed(i))) for i, c in enumerate(columns)]
    none = F.array().cast("array<struct<gram:string,col:int>>")
    every = F.concat(*[F.coalesce(p, none) for p in parts])
    rows = df.select(F.col(row_id).alias("row_id"), F.explode(every).alias("g")).select("g.*", "row_id")
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
    # a gram of many rows is dealt over tasks by the row as well
    salt = F.pmod(F.xxhash64("row_id"), F.lit(8))
    rows = rows.withColumn("bucket", bucket).repartition(F.col("bucket"), salt).sortWithinPartitions("bucket", "gram", "col")
    rows.write.partitionBy("bucket").parquet(f"{root}/postings")
    stored = df.sparkSession.read.parquet(f"{root}/postings")
    stored.groupBy("gram", "bucket").agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{root}/grams")
    return root


def candidates(spark: SparkSession, root: str, query: str) -> DataFrame | None:
    """row_id of the rows that may match (distinct); None if the index cannot tell (an empty query, or one with a mark)."""
    q = query.lower()
    if not q or EDGE in q:
        return None
    grams, postings = spark.read.parquet(f"{root}/grams"), spark.read.parquet(f"{root}/postings")
    if len(q) < N:
        inside = grams.where(F.contains("gram", F.lit(q))).select("gram")
        return postings.join(inside, "gram", "left_semi").select("row_id").distinct()
    wanted = grams_in(q)
    known = grams.where(F.col("gram").isin(wanted)).collect()  # at most one row for each gram of the query
    if len(known) < len(wanted):  # a gram that no value has
        return postings.select("row_id").limit(0)
    rarest = sorted(known, key=lambda r: (r["rows"], r["gram"]))[:RAREST]
    hits = postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in rarest})) & F.col("gram").isin([r["gram"] for r in rarest]))
    both = hits.groupBy("row_id", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest))
    return both.select("row_id").distinct()


def search(df: DataFrame, row_id: str, columns: list[str], root: str, query: str) -> DataFrame:
    """The rows of ``df`` that ``text_match`` finds, checked on the candidates only. Row ids are unique."""
    found = candidates(df.sparkSession, root, query)
    if found is not None:
        ids = found.withColumnRenamed("row_id", "_row_id")
        df = df.join(ids, df[row_id] == ids["_row_id"], "left_semi")
    return df.where(text_match(columns, query))
