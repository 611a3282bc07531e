"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

A batch is reduced to one row per digest (map-side partial aggregation, so that a
text with any number of copies is cheap), anti-joined with the index and appended.
The index is a bucketed table: the sort-merge anti-join shuffles only the batch.

Defined results: null text counts as the empty text. Of rows with equal texts the
largest doc_id stays (null ids are smaller than any; a group of null ids only keeps
null). Rows that repeat both doc_id and text are one document: they share `kept`,
and `deduplicate` returns one of them, the same in every run. An empty table gives an empty result. Only
`doc_id` and `text` are read; other columns may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import attach_groups, random_salt, read, stored
from quillstone.session import scratch_path

SALTS = 64
BUCKETS = 32


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, lower-case hex; null as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """The digests seen so far, as a table bucketed and sorted by digest.

    `path` must be a folder all executors see. A later session opens the same
    index by naming the same path and bucket count.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = BUCKETS):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the digests (digest, keep_id: one row each) that are not in the index yet. Adding again adds nothing."""
        new = groups.join(self.table(), "digest", "left_anti").select("digest", "keep_id")
        new = new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index below the shared folder."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, scratch_path(spark, name), name)


def classify(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of a batch; its new texts go into `index`.

    `keep_id` is the indexed document with that text (for a new text the largest
    doc_id of the batch), `group_size` counts the batch's rows with that text.
    """
    rows = stored(docs.select(F.col("doc_id"), digest(F.col("text")).alias("digest"), random_salt(SALTS).alias("salt")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    index.add(groups)
    sized = attach_groups(
        rows, "digest", "salt",
        {"_n": F.count(F.lit(1))}, {"group_size": F.sum("_n")},
    )
    # the index has one row a digest; its copies are dealt out by salt, so that no key is hot
    slices = rows.groupBy("digest", "salt").agg(F.lit(1).alias("_one")).drop("_one").join(index.table(), "digest")
    return sized.join(slices, ["digest", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns: one row for each text that the index did not have."""
    index = index or new_index(docs.sparkSession)
    groups = docs.select(digest(docs["text"]).alias("digest"), "doc_id").groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    fresh = stored(groups.join(index.table(), "digest", "left_anti"), "fresh")
    index.add(fresh)
    # one row of each text leaves a task, so that copies are not shuffled; ids are compared in a struct, where null is least
    hashed = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.max_by(F.struct(*[docs[c] for c in docs.columns]), F.struct(docs["doc_id"], F.xxhash64(*hashed)))
    chosen = docs.groupBy(digest(docs["text"]).alias("digest")).agg(row.alias("row"))
    return chosen.join(fresh.select("digest"), "digest", "left_semi").select("row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), new_index(spark))


ORACLE_SQL = """
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size,
       doc_id = MAX(doc_id) OVER w AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(COALESCE(text, '')))
"""
