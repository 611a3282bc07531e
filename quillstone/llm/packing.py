"""Packing of tokenised documents into fixed-size sequences by linear grouping.

All that the packing decides depends on how many pieces have which length, and a
length is at most `capacity`: the driver gets that histogram (at most `capacity`
rows, whatever the corpus) and returns a plan whose size is bounded the same way.

1. Large lengths, sorted, are cut into groups of equal cardinality; each length is
   rounded up to the largest of its group, so that few sizes remain.
2. Over these sizes the linear program over configurations (ways to fill one
   sequence) is solved by column generation; the counts are rounded down and the rest
   is packed best-fit in decreasing order.
3. Actual lengths are substituted for the rounded ones, run by run.
4. The small lengths are placed best-fit, longest first, into what is left, and into
   new sequences when nothing fits.

The plan says for each length which ranks go where. Ranks are given on the cluster:
pieces are numbered within (length, salt), and the salts of a length are laid end to
end, so that no task gets all pieces of a common length. The plan is broadcast.

Defined results: null and empty texts are one piece, the end token alone. Only
documents longer than the capacity are cut; their first piece may be shorter. Repeated rows
are packed as often as they occur. An empty table gives an empty result. A text that
holds an added token of the tokenizer has its id there. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import by_value, random_salt, read, small_batches, stored

CAPACITY = 1024
END = 2
GROUPS = 256
#: Lengths up to capacity // SMALL are small.
SMALL = 5
SALTS = 64
VOCABULARY = "byte_bpe_50k"
#: What is encoded at once is cut between words beyond this many characters.
PIECE = 1 << 16

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Contents and ids of the added tokens in the .json form of a rank file; none without such a file."""
    path = f"{path.removesuffix('.tiktoken')}.json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for t in tokens:
        if t["lstrip"] or t["rstrip"] or t["single_word"]:
            raise ValueError(f"added token {t['content']!r} takes its surroundings into account")
    return {t["content"]: t["id"] for t in tokens}


def encoder(path: str):
    """The byte-level BPE of a rank file, as numpy ids of a text; its .json form gives the same ids.

    Texts are split at the added tokens first, the longest of those that begin at one place.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = added_tokens(path)
    splits = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def ids(text: str) -> np.ndarray:
        out, at = [], 0
        for token in splits.finditer(text) if splits else ():
            out += [*between(text[at:token.start()]), np.array([added[token[0]]], np.uint32)]
            at = token.end()
        out += between(text[at:])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def between(text: str) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(text):
            end = at + PIECE
            # a cut before a space that follows a letter or mark and precedes a letter never falls into a token's word
            while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1:end + 2].isalpha()):
                end += 1
            out.append(bpe.encode_to_numpy(text[at:end], disallowed_special=()))
            at = end
        return out

    return ids


def tokenized(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of all pieces of all documents."""
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            docs_, pieces, starts, lengths, ids_ = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                at = 0
                for piece, end in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    docs_.append(i)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(end - at)
                    ids_.append(ids[at:end].tobytes())
                    at = end
            columns = [batch.column("doc_id").take(pa.array(docs_, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids_, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(cut, PIECES)


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping of (length, count), longest first: (rounded size, its runs of actual lengths), equal in cardinality but for the last."""
    total = int(counts.sum())
    each = -(-total // groups) if total else 1
    out, size, runs, room = [], 0, [], each
    for length, count in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while count:
            size = size or length
            take = min(count, room)
            runs.append((length, take))
            count, room = count - take, room - take
            if not room:
                out.append((size, runs))
                size, runs, room = 0, [], each
    if runs:
        out.append((size, runs))
    merged: dict[int, list[tuple[int, int]]] = {}
    for size, runs in out:
        for length, n in runs:
            have = merged.setdefault(size, [])
            if have and have[-1][0] == length:
                have[-1] = (length, have[-1][1] + n)
            else:
                have.append((length, n))
    return sorted(merged.items(), reverse=True)


def best_fill(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest worth: an unbounded knapsack over the capacity, one size after the other."""
    value = np.zeros((len(sizes) + 1, capacity + 1))
    for i, size in enumerate(sizes):
        now = value[i + 1]
        now[:] = value[i]
        for at in range(size, capacity + 1, size):
            part = now[at:at + size]
            np.maximum(part, now[at - size:at - size + len(part)] + worth[i], out=part)
    config, c = np.zeros(len(sizes)), capacity
    for i in range(len(sizes) - 1, -1, -1):
        while c >= sizes[i] and value[i + 1][c] > value[i][c] + 1e-12:
            config[i] += 1
            c -= sizes[i]
    return value[-1][capacity], config


def refined(basis: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """One Newton step of an inverse that rounding has moved (einsum: no threads of a linear algebra library on the driver)."""
    return 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", basis, inverse))


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (items of each size) and how often, covering the demand: column generation, then rounding."""
    k = len(sizes)
    if not k:
        return []
    want = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    for turn in range(10 * k):  # any basis is a plan; more turns only polish a degenerate one
        if turn % 50 == 49:
            inverse = refined(basis, inverse)
        used = np.einsum("ij,j->i", inverse, want)
        worth = inverse.sum(axis=0)
        value, config = best_fill(sizes, np.maximum(worth, 0), capacity)
        # no plan takes fewer than the current sum over the greatest worth: stop when that is near
        if value <= 1 + 1e-7 or used.sum() * (1 - 1 / value) < max(0.5, 1e-5 * used.sum()):
            break
        change = np.einsum("ij,j->i", inverse, config)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        basis[:, leaves] = config
        row = inverse[leaves] / change[leaves]
        inverse -= np.outer(change, row)
        inverse[leaves] = row
    used = np.maximum(np.einsum("ij,j->i", refined(basis, inverse), want), 0)
    left, out = want.astype(np.int64), []
    for i in np.argsort(-used):
        config = basis[:, i].astype(np.int64)
        positive = config > 0
        times = min(int(used[i] + 1e-9), int((left[positive] // config[positive]).min()))
        if times:
            out.append((tuple(int(x) for x in config), times))
            left = left - times * config
    rest: list[list] = []  # the few items that rounding left, best-fit decreasing
    for i, n in enumerate(left.tolist()):
        for _ in range(n):
            fits = [r for r in rest if r[0] >= sizes[i]]
            if fits:
                row = min(fits, key=lambda r: r[0])
            else:
                rest.append(row := [capacity, [0] * k])
            row[0] -= sizes[i]
            row[1][i] += 1
    return out + [(tuple(r[1]), 1) for r in rest]


def plan(lengths: list[int], counts: list[int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first rank, offset): rank r goes to sequence + r - first."""
    length, count = np.array(lengths, np.int64), np.array(counts, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    ranks: dict[int, int] = {}
    sequences = 0

    def put(size: int, times: int, sequence: int, offset: int) -> None:
        first = ranks.get(size, 0)
        rows.append((size, first, first + times, sequence, offset))
        ranks[size] = first + times

    for i in np.flatnonzero(length == capacity):
        put(capacity, int(count[i]), sequences, 0)
        sequences += int(count[i])
    big = (length > capacity // small) & (length < capacity)
    sizes = grouped(length[big], count[big], groups)
    queue = {size: [list(r) for r in runs] for size, runs in sizes}
    #: sequences with equal contents: (room left, offset, how many, the first one)
    open_: list[tuple[int, int, int]] = []
    for config, times in configurations([s for s, _ in sizes], [sum(n for _, n in runs) for _, runs in sizes], capacity):
        slots = [size for (size, _), n in zip(sizes, config, strict=True) for _ in range(n)]
        # substitute actual lengths: as many equal sequences at once as the runs at the slots' heads allow
        while times:
            heads = [queue[s][0] for s in slots]
            n = min([times, *(run[1] // heads_of(heads, run) for run in heads)])
            if not n:  # a run ends within one sequence: fill that one alone
                offset = 0
                for s in slots:
                    run = queue[s][0]
                    put(run[0], 1, sequences, offset)
                    offset += run[0]
                    run[1] -= 1
                    if not run[1]:
                        queue[s].pop(0)
                open_.append((capacity - offset, 1, sequences))
                sequences += 1
                times -= 1
                continue
            offset = 0
            for s in slots:
                run = queue[s][0]
                put(run[0], n, sequences, offset)
                offset += run[0]
                run[1] -= n
            open_.append((capacity - offset, n, sequences))
            for s in set(slots):
                while queue[s] and not queue[s][0][1]:
                    queue[s].pop(0)
            sequences += n
            times -= n
    room: dict[int, list[tuple[int, int]]] = {}
    for left, n, first in open_:
        room.setdefault(left, []).append((n, first))
    for i in np.argsort(-length):
        size, n = int(length[i]), int(count[i])
        if size > capacity // small or not n:
            continue
        for left in sorted(r for r in room if r >= size):
            while n and room.get(left):
                many, first = room[left].pop()
                fit = left // size
                full = min(many, n // fit)
                if full:
                    for j in range(fit):
                        put(size, full, first, capacity - left + j * size)
                    room.setdefault(left - fit * size, []).append((full, first))
                    n -= full * fit
                if full < many and n:  # one sequence takes the last few
                    for j in range(n):
                        put(size, 1, first + full, capacity - left + j * size)
                    room.setdefault(left - n * size, []).append((1, first + full))
                    full, n = full + 1, 0
                if full < many:
                    room[left].append((many - full, first + full))
            if not n:
                break
        if n:
            fit = capacity // size
            full = n // fit
            if full:
                for j in range(fit):
                    put(size, full, sequences, j * size)
                room.setdefault(capacity - fit * size, []).append((full, sequences))
                sequences += full
                n -= full * fit
            if n:
                for j in range(n):
                    put(size, 1, sequences, j * size)
                room.setdefault(capacity - n * size, []).append((1, sequences))
                sequences += 1
    return rows


def heads_of(heads: list[list], run: list) -> int:
    """In how many slots of a configuration this run is at the head."""
    return sum(h is run for h in heads)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """`pieces` (any columns, with length from 1 to the capacity) with sequence_id and offset."""
    rows = stored(pieces.withColumn("_salt", random_salt(SALTS)), "pieces")
    slices = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    slices = stored(slices.withColumn("_before", F.coalesce(before, F.lit(0))), "slices")
    histogram = slices.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # at most `capacity` rows
    if any(not 0 < r["length"] <= capacity for r in histogram):
        raise ValueError("a piece is longer than the capacity, or empty")
    placed = plan([r["length"] for r in histogram], [r["n"] for r in histogram], capacity, groups)
    spark = pieces.sparkSession
    where = spark.createDataFrame(placed, "_length long, _first long, _end long, _sequence long, _offset long")
    here = Window.partitionBy("length", "_salt").orderBy(*pieces.columns)
    ranked = rows.withColumn("_row", F.row_number().over(here) - 1).join(F.broadcast(slices.drop("_n")), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_row") + F.col("_before"))
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    return ranked.join(F.broadcast(where), fits).select(
        *pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: whole sequences of a packed table that still has `ids`; a sequence has at most `capacity` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p.ids", F.unhex(F.lit("")), lambda a, b: F.concat(a, b)).alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(digests(tokenized(docs, path)))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents"))


by_value(__name__)
