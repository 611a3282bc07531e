"""SimHash near-dedup by a binary trie self-join.

A document's fingerprint has 64 bits: a bit is 1 if more than half of the XXH64
hashes of its word shingles have it. Documents with one fingerprint are one class;
the classes are joined by walking pairs of nodes of a binary trie together. A node
pair carries the number of bits in which its two prefixes differ and is dropped as
soon as that exceeds the budget of its depth.

To spread the walk over the cluster, and to prune early, the trie is built three
times, each time with another third of the bits on top: two fingerprints within
`max_bits` differ in at most `max_bits // 3` bits of one third, so below the top
third the budget is that, and `max_bits` below. A unit of work is a top node
together with its smaller neighbours within the top budget. Its walk joins what it
finds by union-find and emits a spanning forest only, never all pairs of a group.
Components follow from the forests by alternating large-star and small-star steps,
each written to the shared folder.

Defined results: null and wordless texts have fingerprint zero and are linked like
any other; fewer words than a shingle count as one shingle. Repeated rows get the
same component. A component's id is its smallest doc_id (null ids are ignored; null
if it has no other). An empty table gives an empty result. Only `doc_id` and `text`
are read; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillstone.llm.common import attach_groups, by_value, free_name, random_salt, read, small_batches, stored

WORDS = 4
MAX_BITS = 4
SEED = 42
SALTS = 64
#: The 64 bits in three thirds; each is on top once.
THIRDS = ((0, 22), (22, 43), (43, 64))
#: Fingerprints a top node should have at most, on average.
NODE = 512
#: Node pairs that a walk holds at once, and the size of a node pair whose members are compared at once.
FRONTIER = 1 << 17
LEAF = 64


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[:-1].tolist()]
    if len(tokens) <= words:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts, (ends[words - 1:] - 1).tolist(), strict=False)
    hashed = xxhash.xxh64_intdigest
    values = np.array([hashed(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    @pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint_of(t, words) for t in batch], dtype="int64")

    return of(text)


def turned(values: np.ndarray, first: int) -> np.ndarray:
    """Rotate 64-bit values left by `first` bits: the third that begins there comes on top."""
    v = values.astype(np.uint64)
    return (v << np.uint64(first)) | (v >> np.uint64(64 - first)) if first else v


def roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = parent[nodes]
    while True:
        up = parent[at]
        if np.array_equal(up, at):
            return at
        at = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays of links; the smaller index is the root."""
    while len(a):
        a, b = roots(parent, a), roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def walk(values: np.ndarray, own: np.ndarray, depth: int, top: int, top_budget: int, budget: int) -> np.ndarray:
    """Parents of a union-find over `values` (sorted, distinct): links within `budget` bits where one end is `own`.

    The walk starts with the pairs of nodes at `depth` that hold the values; the
    prefixes of values under one node are equal.
    """
    n = len(values)
    parent = np.arange(n)
    heads = values >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    first = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
    last = np.r_[first[1:], n]
    mine = int(np.flatnonzero(own[first])[0]) if own.any() else -1
    if mine < 0:
        return parent
    apart = np.bitwise_count(heads[first] ^ heads[first[mine]]).astype(np.int64)
    start = np.arange(len(first))
    stack = [(depth, np.full(len(start), first[mine]), np.full(len(start), last[mine]), first[start], last[start], apart)]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            cut = len(alo) // 2
            stack += [(d, *(x[:cut] for x in (alo, ahi, blo, bhi, err))), (d, *(x[cut:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF) | (d == 64)
        if small.any():
            members(values, parent, alo[small], ahi[small], blo[small], bhi[small], budget)
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        amid, bmid = split(values, alo, ahi, d), split(values, blo, bhi, d)
        same = alo == blo
        limit = top_budget if d + 1 <= top else budget
        kids = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            a0, a1 = (alo, amid) if x == 0 else (amid, ahi)
            b0, b1 = (blo, bmid) if y == 0 else (bmid, bhi)
            e = err + (x != y)
            # a node joined with itself has its two halves' pair once
            live = (a1 > a0) & (b1 > b0) & (e <= limit) & ~(same & (x == 1) & (y == 0))
            kids.append((a0[live], a1[live], b0[live], b1[live], e[live]))
        stack.append((d + 1, *(np.concatenate(z) for z in zip(*kids, strict=True))))
    return parent


def split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
    """Where the members of nodes at depth `d` begin to have bit 1 next."""
    bit = np.uint64(63 - d)
    edge = ((values[lo] >> bit) | np.uint64(1)) << bit
    return np.clip(np.searchsorted(values, edge), lo, hi)


def members(values: np.ndarray, parent: np.ndarray, alo, ahi, blo, bhi, budget: int) -> None:
    """Compare the members of small node pairs and unite those within the budget."""
    na, nb = ahi - alo, bhi - blo
    pairs = na * nb
    for at in range(0, len(pairs), 1 << 14):
        part = slice(at, at + (1 << 14))
        n = pairs[part]
        which = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        a = alo[part][which] + i // nb[part][which]
        b = blo[part][which] + i % nb[part][which]
        apart = values[a] ^ values[b]
        near = (np.bitwise_count(apart) <= budget) & (a != b)
        unite(parent, a[near], b[near])


def units(classes: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """unit, turn, own, fp: each fingerprint in its own top node, and in each larger node within the top budget, once a third."""
    top_budget = max_bits // 3

    @pandas_udf("array<struct<turn:int,unit:long,own:boolean>>")
    def places(fps: pd.Series) -> pd.Series:
        values = fps.to_numpy().astype(np.int64).view(np.uint64)
        out = [[] for _ in range(len(values))]
        for turn, (first, end) in enumerate(THIRDS):
            d = min(depth, end - first)
            node = (turned(values, first) >> np.uint64(64 - d)).astype(np.int64) if d else np.zeros(len(values), np.int64)
            for mask in masks(d, top_budget):
                other = node ^ mask
                for i in np.flatnonzero(other >= node):
                    out[i].append({"turn": turn, "unit": int(other[i]), "own": mask == 0})
        return pd.Series(out)

    return classes.select("fp", F.explode(places("fp")).alias("p")).select("fp", "p.*")


def masks(depth: int, bits: int) -> list[int]:
    """All patterns of at most `bits` ones among `depth` bits."""
    found = {0}
    for _ in range(bits):
        found |= {m | (1 << b) for m in found for b in range(depth)}
    return sorted(found)


def links(classes: DataFrame, n_classes: int, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, root: a spanning forest for each unit, over distinct fingerprints (column fp)."""
    depth = max(1, int(np.ceil(np.log2(max(n_classes, 1) / NODE)))) if n_classes > NODE else 0
    depth = min(depth, min(end - first for first, end in THIRDS))
    top_budget = max_bits // 3

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        first, end = THIRDS[int(key[0])]
        fps = group["fp"].to_numpy()
        values = turned(fps.view(np.uint64), first)
        order = np.argsort(values)
        parent = walk(values[order], group["own"].to_numpy()[order], min(depth, end - first), end - first, top_budget, max_bits)
        root = roots(parent, np.arange(len(parent)))
        linked = root != np.arange(len(root))
        return pd.DataFrame({"fp": fps[order][linked], "root": fps[order][root[linked]]})

    return units(classes, depth, max_bits).groupBy("turn", "unit").applyInPandas(join, "fp long, root long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of `edges` (u, v), by large-star and small-star steps."""
    edges = stored(directed(edges), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct(), "large-star")
        near = star(large)
        small = near.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(near.select("u", F.col("least").alias("v")))
        after = stored(small.where("u <> v").distinct(), "small-star")
        moved = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not moved:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def star(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least node among u and all its neighbours."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return attach_groups(salted, "u", "salt", {"_least": F.min("v")}, {"_low": F.min("_least")}).select(
        "u", "v", F.least("u", "_low").alias("least")
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, **also: Column) -> DataFrame:
    """doc_id, fp (signed 64 bits), component_id, and the columns `also`, for every row of `docs`."""
    small_batches(docs.sparkSession)
    rows = stored(docs.select("doc_id", fingerprint(docs["text"], words).alias("fp"), random_salt(SALTS).alias("salt"), *[c.alias(n) for n, c in also.items()]), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    forests = links(classes.select("fp"), classes.count(), max_bits)
    roots_of = components(forests.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    placed = classes.join(roots_of, classes["fp"] == roots_of["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")), "placed")
    named = attach_groups(placed, "root", "salt", {"_id": F.min("first_id")}, {"component_id": F.min("_id")}).select("fp", "component_id")
    slices = rows.select("fp", "salt").distinct().join(named, "fp")
    return rows.join(slices, ["fp", "salt"]).select("doc_id", "fp", "component_id", *also)


def one_of_each(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id, all columns as they are.

    A row is told by its doc_id and its text: of different texts that share a doc_id only those stay whose own component has that id.
    """
    digest = lambda: F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    found = near_duplicates(docs, words, max_bits, _digest=digest()).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = stored(found.select(F.col("doc_id").alias("_keep_id"), F.col("_digest").alias("_keep_digest")).distinct(), "stay")
    ids, digests = free_name(docs, "_keep_id"), free_name(docs, "_keep_digest")
    found = found.select(F.col("_keep_id").alias(ids), F.col("_keep_digest").alias(digests)).hint("merge")
    return docs.join(found, docs["doc_id"].eqNullSafe(found[ids]) & (digest() == found[digests]), "left_semi")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


by_value(__name__)
