"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it begins
at an offset and steps by a skip, both hashed from its name, and so visits every slot.
Shards take turns; at its turn a shard claims the first slot of its order that is still
free (a shard of weight w claims w slots). Slots are dealt almost evenly, and most
stay where they were when shards are added or removed.

A row's key is hashed to a slot and the slot is looked up in the table, which is
broadcast: at most MAX_SLOTS rows, whatever the data. Where a key may be heavy, `spread`
splits it: a key with more than a fair share of all rows gets parts that are placed one
by one. There are fewer such keys than shards, so their list is broadcast too.

Defined results: a null key is placed like the empty string. Equal keys go to one shard
(but for parts of heavy ones), so repeated rows stay together. An empty table gives
an empty result. All columns are kept as they are; `slot` and `shard` are added (and replace
columns of that name, which may still be the key).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import free_name, read

SLOTS = 4099
SHARDS = 32
MAX_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[str]:
    """The shard of each slot."""
    if not is_prime(slots) or slots > MAX_SLOTS or not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError(f"needs a prime number of at most {MAX_SLOTS} slots, and as many or fewer distinct shards")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("needs a weight of at least 1 for each shard")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:8], 16) % slots for d in digests]
    skip = [int(d[8:16], 16) % (slots - 1) + 1 for d in digests]
    table: list[str | None] = [None] * slots
    left = slots
    while left:
        for i, shard in enumerate(shards):
            for _ in range(min(weights[i], left)):
                while table[at[i]] is not None:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = shard
                left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """`rows` with `slot` and `shard` added."""
    table = list(enumerate(lookup_table(shards, slots, weights)))
    at, number = free_name(rows, "_at"), free_name(rows, "_slot")
    table = rows.sparkSession.createDataFrame(table, f"{number} long, shard string")
    placed = rows.withColumn(at, slot_of(key, slots)).drop("slot", "shard")
    return placed.join(F.broadcast(table), placed[at] == table[number], "left").withColumn("slot", F.col(at)).drop(at, number)


def spread(rows: DataFrame, key: str, within: Column, shards: int = SHARDS) -> Column:
    """A key for `place`: as `key`, but a key with over 1/shards of all rows becomes enough parts, dealt by the hash of `within`."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = {r[key]: -(-r["n"] * shards // total) for r in counts.where(F.col("n") * shards > total).collect()}  # fewer than `shards` rows
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = text
    for value, parts in heavy.items():
        part = F.pmod(F.xxhash64(within), F.lit(int(parts)))
        out = F.when(F.col(key).eqNullSafe(F.lit(value)), F.concat_ws("#", text, part)).otherwise(out)
    return out


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return place(docs, F.col("doc_id"), [f"shard-{i:02d}" for i in range(SHARDS)])


#: The turns, one a step: state is who has which slot, and how far each shard's order has been read.
ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%02d', i) AS shard,
         ('0x' || substr(md5(printf('shard-%02d', i)), 1, 8))::BIGINT % {SLOTS} AS start,
         ('0x' || substr(md5(printf('shard-%02d', i)), 9, 8))::BIGINT % {SLOTS - 1} + 1 AS skip
  FROM range({SHARDS}) t(i)),
orders AS (SELECT list(start ORDER BY i) AS starts, list(skip ORDER BY i) AS skips FROM shards),
turns AS (
  SELECT 0::BIGINT AS turn, NULL::BIGINT AS slot, list_transform(range({SLOTS}), lambda x: false) AS taken
  UNION ALL
  SELECT turn + 1, s, list_transform(taken, lambda x, i: x OR i = s + 1)
  FROM (
    SELECT turn, taken, list_extract(list_filter(
             list_transform(range({SLOTS}), lambda j: (starts[turn % {SHARDS} + 1] + j * skips[turn % {SHARDS} + 1]) % {SLOTS}),
             lambda x: NOT taken[x + 1]), 1) AS s
    FROM turns, orders WHERE turn < {SLOTS}))
SELECT doc_id, slot, shard FROM (
  SELECT doc_id, ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS} AS slot FROM documents)
JOIN turns USING (slot) JOIN shards ON i = (turn - 1) % {SHARDS}
"""
