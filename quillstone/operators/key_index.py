"""C1 / C3 over appended batches: a persisted key index with a Bloom prefilter.

The index has two bucketed tables: the keys of all batches (by digest, with how often
each occurs in a batch), and for each batch and part of the key space a Bloom filter (by part).
A new batch is reduced to its distinct keys, dealt to the filters' buckets and tested; only
keys that some filter may have are dealt to the keys' buckets and looked up. Both tables
are read in their buckets, so only the batch is shuffled, however many batches there are. A
filter's false positives cost a look-up and no result; it has no false negatives.

A later session opens the same index by naming the same folder, buckets and bits.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bits that a key sets in its part's filter.
HASHES = 4


class KeyIndex:
    """Keys (columns ``keys``) seen so far, below ``path``; ``bits`` a part: about 16 for each key that a batch has in a part."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, bits: int = 1 << 16):
        self.spark, self.keys, self.buckets, self.words = spark, keys, buckets, bits // 64
        name = f"key_index_{uuid.uuid4().hex}"
        self.seen, self.filters = f"{name}_keys", f"{name}_filters"
        spark.sql(f"CREATE TABLE {self.seen} (digest STRING, n BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/keys'")
        spark.sql(f"CREATE TABLE {self.filters} (part INT, bits ARRAY<BIGINT>, batch STRING) USING parquet "
                  f"CLUSTERED BY (part) SORTED BY (part) INTO {buckets} BUCKETS LOCATION '{path}/filters'")

    # -- keys

    def digest(self) -> Column:
        """SHA-256 of the key columns; null is a value like any other."""
        return F.sha2(F.to_json(F.struct(*[F.col(k) for k in self.keys])), 256)

    def counted(self, batch: DataFrame) -> DataFrame:
        """digest, part and n of a batch's distinct keys."""
        per = batch.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        return per.withColumn("digest", self.digest()).withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int"))

    def places(self) -> list[tuple[Column, Column]]:
        """(word, bit) of a digest's bits."""
        at = [F.pmod(F.xxhash64("digest", F.lit(i + 1)), F.lit(self.words * 64)) for i in range(HASHES)]
        return [(F.floor(a / 64).cast("int"), (a % 64).cast("int")) for a in at]

    def may_have(self) -> Column:
        one = F.lit(1).cast("long")
        tests = [F.element_at("bits", word + 1).bitwiseAND(F.call_function("shiftleft", one, bit)) != 0 for word, bit in self.places()]
        return reduce(lambda a, b: a & b, tests)

    # -- a batch

    def add(self, batch: DataFrame, name: str) -> None:
        """Append a batch's keys and its filters."""
        per = self.counted(batch).select("digest", "part", "n")
        keys = per.select("digest", "n", F.lit(name).alias("batch"))
        keys.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").format("parquet") \
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.seen)
        one = F.lit(1).cast("long")
        each = F.array(*[F.struct(w.alias("word"), F.call_function("shiftleft", one, b).alias("bits")) for w, b in self.places()])
        set_bits = per.select("part", F.explode(each).alias("e")).groupBy("part", "e.word").agg(F.bit_or("e.bits").alias("bits"))
        whole = set_bits.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
        bits = F.transform(F.sequence(F.lit(0), F.lit(self.words - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long")))
        filters = whole.select("part", bits.alias("bits"), F.lit(name).alias("batch"))
        filters.repartition(self.buckets, "part").sortWithinPartitions("part").write.mode("append").format("parquet") \
            .bucketBy(self.buckets, "part").sortBy("part").saveAsTable(self.filters)

    def candidates(self, per: DataFrame) -> DataFrame:
        """The distinct keys (of ``counted``) that some earlier batch may have: each part's filters of all batches in one scan."""
        filters = self.spark.table(self.filters).select(F.col("part").alias("_part"), "bits").hint("merge")
        return per.join(filters, (F.col("part") == F.col("_part")) & self.may_have(), "left_semi")

    def earlier(self, per: DataFrame) -> DataFrame:
        """digest and how often it occurs in earlier batches, for the candidates that do."""
        known = self.spark.table(self.seen).hint("merge")
        return self.candidates(per).select("digest").join(known, "digest").groupBy("digest").agg(F.sum("n").alias("before"))

    def check_unique(self, batch: DataFrame) -> DataFrame:
        """Keys of the batch that occur more than once so far, with their number in all batches and this one."""
        per = self._kept(self.counted(batch))
        both = per.join(self._kept(self.earlier(per)), "digest", "left")
        total = F.col("n") + F.coalesce("before", F.lit(0))
        return both.select(*self.keys, total.alias("occurrences")).where(F.col("occurrences") > 1)

    def missing(self, children: DataFrame) -> DataFrame:
        """Rows of a batch of children whose key (no part of it null) is not in the index."""
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        per = self._kept(self.counted(children.where(known)))
        found = self.earlier(per).select("digest")
        lost = per.join(found, "digest", "left_anti").select(*self.keys)
        return children.join(lost, self.keys, "left_semi")

    def _kept(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "quillstone", f"key-batch-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def unique_over_batches(index: KeyIndex, batches: list[tuple[str, DataFrame]]) -> DataFrame:
    """C1 over batches that come one after the other: each is checked against all before it, and added. A key's newest count stands."""
    out = None
    for i, (name, batch) in enumerate(batches):
        part = index._kept(index.check_unique(batch).withColumn("_batch", F.lit(i)))
        index.add(batch, name)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*index.keys).agg(F.max_by("occurrences", "_batch").alias("occurrences"))
