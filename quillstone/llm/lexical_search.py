"""Ranked lexical search with K2-treaps over the grid of terms and documents.

Documents are dealt into shards where they are read. A shard is a grid: a row for each
of its terms, a column for each of its documents, and in a cell the impact of the term
in the document (an integer that grows with the term's share of the document). The grid
is kept as a K2-treap: a quadtree that stores, level by level, four bits for each
non-empty cell (which quadrants are non-empty) and the largest impact below it, as the
difference from its parent's. Children are found by counting bits; empty cells cost
nothing. Common terms lie far apart, between rare ones, so that a common term's cells hold
its own impacts; columns are ordered by their commonest term and length, so that ranges
hold alike documents.

A query is a set of weighted terms. Within a shard it starts with one document range,
all columns, and the root cell for each of its terms. Expanding a range halves it: each
term's row path descends to the child cells on both sides. The sum of weight times the
cell's maximum bounds every score within the range; ranges are expanded best first, in
batches, and dropped as soon as their bound is below the k-th best score found. At the
last level the sums are the exact scores. The best of each shard are merged in two
steps, by (item, salt) and by item.

The index holds all terms of all documents and does not depend on the queries. These
are searched in blocks: a task gets the block's terms and weights, at most ITEMS items.
A few shards are searched first; the k-th best score in them is a floor for the others,
which lets them drop ranges early and return few rows, and changes no result.

Defined results: null texts and texts without a term are in no result and are not
counted. Rows that share a doc_id are documents of their own; null ids come last among
equal scores. Rows of one item_id (null too) are one item with the terms of all of them; an
item without a term in any document has no rows. An empty table gives an empty result.
Only doc_id, item_id and text are read; other columns may have any names.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import by_value, read, small_batches, stored
from quillstone.session import scratch_path

TOP = 50
#: A shard is closed beyond these many documents or postings.
DOCS, POSTINGS = 1 << 13, 1 << 20
#: Items and terms of a block of queries; ranges that are expanded at once; shards that give the floors.
ITEMS, TERMS, BATCH, SEEDS = 256, 1 << 16, 256, 4
SALTS = 64
#: What is split at once is cut between terms beyond this many characters.
PIECE = 1 << 20

SEPARATOR = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
#: Bytes of a term are kept, A-Z lower-cased; all others become spaces.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

INDEX = "shard long, ids binary, no_id binary, terms binary, df binary, sizes array<int>, top int, masks binary, drops binary"
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def plain_pieces(text: str | None) -> Iterator[bytes]:
    """A text (UTF-8) as terms and spaces, cut between terms."""
    at, text = 0, text or ""
    while at < len(text):
        cut = SEPARATOR.search(text, at + PIECE) if len(text) > at + PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].encode("utf-8", "surrogatepass").translate(TERM_BYTES)
        at = end


def counted(text: str | None) -> Counter:
    """The terms of a text and how often each occurs."""
    out: Counter = Counter()
    for piece in plain_pieces(text):
        out.update(piece.split())
    return out


def length_of(text: str | None) -> int:
    """How many terms a text has: the places where one begins."""
    n = 0
    for piece in plain_pieces(text):
        term = np.frombuffer(piece, np.uint8) != 0x20
        n += int(term[0]) + int(np.count_nonzero(term[1:] & ~term[:-1]))
    return n


class Statistics(NamedTuple):
    """Documents with a term, and terms of all documents."""

    documents: int
    terms: int


def statistics(docs: DataFrame) -> Statistics:
    """Counted over all rows of `docs` (column text)."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = length_of(text)
                n, terms = n + (found > 0), terms + found
        yield pa.RecordBatch.from_pydict({"n": [n], "terms": [terms]})

    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return Statistics(row[0] or 0, row[1] or 0)


def impact(tf: np.ndarray, n: np.ndarray, stats: Statistics) -> np.ndarray:
    """The share of a term in the score of a document of `n` terms that holds it `tf` times, before its weight."""
    m = 50 + (50 * n * stats.documents) // max(stats.terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, stats: Statistics) -> int:
    return math.floor(1000 * math.log((2 * stats.documents + 2) / (2 * df + 1)))


def spread_bits(x: np.ndarray) -> np.ndarray:
    """The low 32 bits, each followed by a zero bit."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def far_apart(n: int) -> np.ndarray:
    """Rows for `n` terms, commonest first: each as far as can be from those before, so that a common term's neighbours are rare."""
    bits = max(1, (n - 1).bit_length())
    at, turned = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for b in range(bits):
        turned |= ((at >> b) & 1) << (bits - 1 - b)
    return turned[:n]


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class Grid:
    """Collects the postings of a shard's documents and builds its treap."""

    def __init__(self) -> None:
        self.numbers, self.ids, self.lengths, self.rows, self.tfs, self.postings = Numbers(), [], [], [], [], 0

    def add(self, doc_id: int | None, terms: Counter) -> None:
        self.ids.append(doc_id)
        self.lengths.append(terms.total())
        self.rows.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)))
        self.tfs.append(np.fromiter(terms.values(), np.int64, len(terms)))
        self.postings += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= DOCS or self.postings >= POSTINGS

    def treap(self, shard: int, stats: Statistics) -> pa.RecordBatch:
        """One row of INDEX."""
        sizes = np.array([len(r) for r in self.rows])
        rows, tfs = np.concatenate(self.rows), np.concatenate(self.tfs)
        docs = np.repeat(np.arange(len(sizes)), sizes)
        df = np.bincount(rows, minlength=len(self.numbers))
        by_df = np.argsort(-df, kind="stable")
        rank = np.empty_like(by_df)
        rank[by_df] = np.arange(len(by_df))
        place = far_apart(len(df))[rank]
        lengths = np.array(self.lengths, np.int64)
        commonest = np.array([rank[r[t.argmax()]] for r, t in zip(self.rows, self.tfs, strict=True)])
        by_kind = np.lexsort((lengths, commonest))
        column = np.empty_like(by_kind)
        column[by_kind] = np.arange(len(by_kind))
        codes = (spread_bits(place[rows]) << np.uint64(1)) | spread_bits(column[docs])
        order = np.argsort(codes)
        codes, values = codes[order], impact(tfs, lengths[docs], stats)[order]
        depth = max(1, int(len(df) - 1).bit_length(), int(len(sizes) - 1).bit_length())
        masks, drops, counts = [], [], [len(codes)]
        for _ in range(depth):
            parents = codes >> np.uint64(2)
            new = np.r_[True, parents[1:] != parents[:-1]]
            starts = np.flatnonzero(new)
            masks.append(np.bitwise_or.reduceat((1 << (codes & np.uint64(3)).astype(np.uint8)).astype(np.uint8), starts))
            best = np.maximum.reduceat(values, starts)
            drops.append(best[np.cumsum(new) - 1] - values)
            codes, values = parents[starts], best
            counts.append(len(codes))
        terms = list(self.numbers)
        ids = [self.ids[i] for i in by_kind]
        bits = np.concatenate(masks[::-1])
        nibbles = np.r_[bits, np.zeros(len(bits) % 2, np.uint8)]
        made = {
            "shard": [shard], "ids": [np.array([i or 0 for i in ids], "<i8").tobytes()], "no_id": [np.array([i is None for i in ids], np.uint8).tobytes()],
            "terms": [b" ".join([terms[i] for i in by_df])], "df": [df[by_df].astype("<i4").tobytes()],
            "sizes": [counts[::-1]], "top": [int(values[0])],
            "masks": [zstandard.ZstdCompressor(level=1).compress((nibbles[::2] | (nibbles[1::2] << 4)).tobytes())], "drops": [squeezed(np.concatenate(drops[::-1]))],
        }
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), types, strict=True)], list(made))


class Treap:
    """One shard's grid, opened for searching: masks, first children and maxima by level, each with a last, empty cell."""

    def __init__(self, row: dict) -> None:
        self.ids, self.no_id = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["no_id"], np.uint8).astype(bool)
        terms = row["terms"].split(b" ")
        self.row_of = dict(zip(terms, far_apart(len(terms)).tolist(), strict=True))
        self.depth = len(row["sizes"]) - 1
        packed = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["masks"]), np.uint8)
        masks = np.stack([packed & 15, packed >> 4], axis=1).ravel()
        drops = unsqueezed(row["drops"])
        self.masks, self.first, self.best = [], [], [np.array([row["top"], 0])]
        at = below = 0
        for size, children in zip(row["sizes"], row["sizes"][1:], strict=False):
            mask = masks[at:at + size]
            ones = _ONES[mask]
            self.masks.append(np.append(mask, 0))
            self.first.append(np.append(np.cumsum(ones) - ones, 0))
            self.best.append(np.append(np.repeat(self.best[-1][:-1], ones) - drops[below:below + children], 0))
            at, below = at + size, below + children

    def top(self, terms: list[tuple[bytes, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of all documents that may be among the best `k` with a score of `floor` or more: none that is, is missing."""
        found = [(self.row_of[t], w) for t, w in terms if t in self.row_of and w > 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, weights = (np.array(x, np.int64) for x in zip(*found, strict=True))
        floor = max(floor, 1)
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = int((weights * self.best[0][0]).sum())
        #: chunks of document ranges of one level: columns, a cell for each term and range, bounds
        chunks = [(-start, 0, 0, np.zeros(1, np.int64), np.zeros((len(rows), 1), np.int64), np.array([start]))]
        made = 0
        while chunks and -chunks[0][0] >= floor:
            _, _, level, ranges, cells, bounds = heapq.heappop(chunks)
            live = bounds >= floor
            if not live.all():
                ranges, cells, bounds = ranges[live], cells[:, live], bounds[live]
            if level == self.depth:
                columns, scores = np.concatenate([columns, ranges]), np.concatenate([scores, bounds])
                if len(scores) >= k:
                    floor = max(floor, int(np.partition(scores, -k)[-k]))
                    columns, scores = columns[scores >= floor], scores[scores >= floor]
                continue
            if len(ranges) > BATCH:
                order = np.argsort(-bounds)
                ranges, cells, bounds = ranges[order], cells[:, order], bounds[order]
                made += 1
                heapq.heappush(chunks, (-int(bounds[BATCH]), made, level, ranges[BATCH:], cells[:, BATCH:], bounds[BATCH:]))
                ranges, cells = ranges[:BATCH], cells[:, :BATCH]
            mask, first, empty = self.masks[level][cells], self.first[level][cells], len(self.best[level + 1]) - 1
            side = ((rows >> (self.depth - 1 - level)) & 1)[:, None] * 2
            halves = []
            for half in (0, 1):
                quadrant = side + half
                child = np.where((mask >> quadrant) & 1, first + _ONES[mask & ((1 << quadrant) - 1)], empty)
                halves.append((ranges * 2 + half, child, weights @ self.best[level + 1][child]))
            ranges, bounds = np.concatenate([h[0] for h in halves]), np.concatenate([h[2] for h in halves])
            live = bounds >= floor
            if live.any():
                made += 1
                heapq.heappush(chunks, (-int(bounds.max()), made, level + 1, ranges[live], np.concatenate([h[1] for h in halves], axis=1)[:, live], bounds[live]))
        return columns, scores


def indexed(docs: DataFrame, stats: Statistics) -> DataFrame:
    """The index of all rows of `docs` (doc_id, text), a row for each shard, written below the shared folder."""
    small_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, grid = TaskContext.get().partitionId() << 32, Grid()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if terms := counted(text):
                    grid.add(doc_id, terms)
                    if grid.full():
                        yield grid.treap(shard, stats)
                        shard, grid = shard + 1, Grid()
        if grid.ids:
            yield grid.treap(shard, stats)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, INDEX)
    path = scratch_path(docs.sparkSession, f"treaps-{uuid.uuid4().hex}")
    # a shard's row is some MB: few rows a file, so that a reader's batch of rows stays small
    rows.write.option("maxRecordsPerFile", 4).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def queries_of(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in counted(text)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(split, "item_id long, term binary").groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def blocks_of(queries: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries, a bounded block after the other."""
    block, terms = [], 0
    for row in queries.toLocalIterator():
        if block and (len(block) == ITEMS or terms + len(row["terms"]) > TERMS):
            yield block
            block, terms = [], 0
        block.append((row["item_id"], [bytes(t) for t in row["terms"]]))
        terms += len(row["terms"])
    if block:
        yield block


def frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each wanted term occurs."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for terms, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                for term, n in zip(terms.split(b" "), np.frombuffer(df, "<i4").tolist(), strict=True):
                    if term in wanted:
                        total[term] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "df"])

    rows = index.select("terms", "df").mapInArrow(look, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r["term"]): r["df"] for r in rows}


def answers(index: DataFrame, block: list[tuple[int, list[tuple[bytes, int]]]], k: int, floors: dict[int, int]) -> DataFrame:
    """item (its number in the block), doc_id, score: the best of every shard, merged to the best `k` for each item."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                treap, out = Treap(row), []
                for item, terms in block:
                    columns, scores = treap.top(terms, k, floors.get(item, 0))
                    ids, none = treap.ids[columns], treap.no_id[columns]
                    best = np.lexsort((ids, none, -scores))[:k]
                    out += [(item, None if z else i, s) for z, i, s in zip(none[best].tolist(), ids[best].tolist(), scores[best].tolist(), strict=True)]
                found = zip(*out, strict=True) if out else ((), (), ())
                salt = pa.array([row["shard"] % SALTS ^ (row["shard"] >> 32) % SALTS] * len(out), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in found), salt], ["item", "doc_id", "score", "salt"])

    found = index.mapInArrow(search, "item long, doc_id long, score long, salt int")
    for keys in (["item", "salt"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.drop("salt")


def ranked(index: DataFrame, stats: Statistics, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best `k` documents of the index for every item of `items` (item_id, text)."""
    spark = index.sparkSession
    seeds = [r["shard"] for r in index.select("shard").orderBy("shard").limit(SEEDS).collect()]
    queries = stored(queries_of(items), "queries")
    results = []
    for block in blocks_of(queries):
        df = frequencies(index, {t for _, terms in block for t in terms})
        weighted = [(number, [(t, weight(df[t], stats)) for t in terms if t in df]) for number, (_, terms) in enumerate(block)]
        first = answers(index.where(F.col("shard").isin(seeds)), weighted, k, {}).where(F.col("rank") == k).collect()
        found = answers(index, weighted, k, {r["item"]: r["score"] for r in first})
        names = spark.createDataFrame([(number, item) for number, (item, _) in enumerate(block)], "item long, item_id long")
        results.append(stored(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "answers"))
    out = results[0] if results else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def searched(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index and search in one: the best `k` of `docs` for every item."""
    stats = statistics(docs)
    return ranked(indexed(docs, stats), stats, items, k)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
sized AS (SELECT r, doc_id, len(words)::BIGINT AS n, words FROM docs WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
posting AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(words) AS t FROM sized) GROUP BY ALL),
wanted AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark)),
weights AS (
    SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM posting, total WHERE t IN (SELECT t FROM wanted) GROUP BY t),
scored AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
    FROM wanted JOIN weights USING (t) JOIN posting USING (t), total GROUP BY ALL),
ranks AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= {TOP}
"""

by_value(__name__)
