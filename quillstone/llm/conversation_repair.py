"""Repair of conversations' turn structure by Hirschberg's divide and conquer.

A well-formed conversation reads `(s?(ua)+)?` in the first letters of its roles. Rows are
edited at a cost: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must
go), Insert an empty user or assistant turn 5; a truncated row that stays costs 5 more. Four
states (nothing yet, after s, after u, after a) say what may follow. The audit is the string of the
cheapest edits' initials; among equally cheap ones the least in ASCII order.

A cost vector has, for each of the four states, the least cost of reaching it and the place
of its least audit among the four. No audit of one state is the beginning of another's (each
ends with the edit of the same row), so places are enough to break ties and no string is
carried. To find a conversation's audit, a forward vector from its begin and a backward
vector from its end meet in the middle row; the cheapest crossing with the least audit is
taken, and both halves are solved alike. Memory is one vector a level.

On the cluster the same meeting is done twice. Rows are put in order by a range partition
of (conversation, turn), so that a conversation of any length spreads over many tasks, and are cut
into blocks of at most BLOCK rows. A block's vectors from each of the four states are
computed on their own; over the blocks of a conversation, four states a block, forward
vectors and a backward trace choose the crossing between neighbouring blocks; then every block
is solved on its own between its two states.

Rows that must be deleted change no state: they are `D` in the audit, before any insert that
could stand there, and are not part of the search. Rows alike in conversation, turn, role and text are one row with a
count, whatever their number.

Defined results: nulls in role and text are one space. Rows of a null conv_id are one
conversation. Within a conversation rows are ordered by turn (nulls first), role and SHA-256 of the
text; a row is a duplicate if one before it has its role and text. A conversation without rows
has zeros, an empty audit and the digest of the empty string. An empty table gives an empty result.
Only conv_id, turn, role and text are read. The digest of a repaired conversation is a chain over its
rows: one task streams them in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import attach_groups, by_value, read, small_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 1024
SALTS = 64

#: States: nothing yet, after system, after user, after assistant; what a letter does in each, and the role that an insert or rerole gives.
STATES = range(4)
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVES = ("user", "user", "assistant", "user")
NEXT = tuple(AFTER[x][GIVES[x][0]] for x in STATES)
#: What a conversation may end with, and the inserts that lead there.
ENDS = ("", "II", "I", "")
NEVER = 1 << 40
#: A row's code: its role's letter, upper case if truncated; rows that must go have MUST.
LETTERS, OTHER, MUST = "sua", "o", "x"

Vector = tuple[tuple[int, int], ...]
"""(cost, place of the audit among the states) for each state."""


@lru_cache(maxsize=None)
def steps(code: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """From each state to each: the cheapest way through a row, inserts before it and one edit, ties least."""
    letter, late = code.lower(), TRUNCATED if code.isupper() else 0
    out = []
    for x in STATES:
        best: list[tuple[int, str] | None] = [None] * 4
        at, before, cost = x, "", 0
        for _ in range(4):
            ways = [(at, "D", DELETE), (NEXT[at], "R", REROLE + late)]
            if letter in AFTER[at]:
                ways.append((AFTER[at][letter], "K", KEEP + late))
            for y, edit, more in ways:
                way = (cost + more, before + edit)
                best[y] = min(best[y], way) if best[y] else way
            at, before, cost = NEXT[at], before + "I", cost + INSERT
        out.append(tuple(best))
    return tuple(out)


def placed(found: list[tuple[int, tuple] | None]) -> Vector:
    """A vector from (cost, key) of each state, where keys are ordered as the audits are."""
    keys = sorted(f[1] for f in found if f)
    return tuple((f[0], keys.index(f[1])) if f else (NEVER, 4) for f in found)


def start(x: int) -> Vector:
    return tuple((0, 0) if y == x else (NEVER, 4) for y in STATES)


def forward(vector: Vector, codes: str) -> Vector:
    """The vector after the rows of `codes`."""
    for code in codes:
        found: list[tuple[int, tuple] | None] = [None] * 4
        for x, (cost, place) in enumerate(vector):
            if cost < NEVER:
                for y, way in enumerate(steps(code)[x]):
                    if way:
                        new = (cost + way[0], (place, way[1]))
                        found[y] = min(found[y], new) if found[y] else new
        vector = placed(found)
    return vector


def backward(costs: tuple[int, ...], codes: str) -> tuple[int, ...]:
    """The least cost from each state through the rows of `codes` to the end, whose costs are given."""
    for code in reversed(codes):
        costs = tuple(min(way[0] + costs[y] for y, way in enumerate(ways) if way) for ways in steps(code))
    return costs


def crossing(before: Vector, after: tuple[int, ...]) -> int:
    """Of the cheapest states to meet in, the one whose audit so far is least."""
    return min(STATES, key=lambda x: (before[x][0] + after[x], before[x][1]))


def solve(codes: str, x: int, y: int) -> list[str]:
    """The edits of each row (inserts before it included) on the least of the cheapest ways from state x to y."""
    if len(codes) < 2:
        return [steps(c)[x][y][1] for c in codes]
    middle = len(codes) // 2
    meet = crossing(forward(start(x), codes[:middle]), backward(tuple(0 if s == y else NEVER for s in STATES), codes[middle:]))
    return solve(codes[:middle], x, meet) + solve(codes[middle:], meet, y)


@lru_cache(maxsize=1 << 14)
def transfer(codes: str) -> tuple[Vector, ...]:
    """A block's vectors, one for each state before it."""
    return tuple(forward(start(x), codes) for x in STATES)


@lru_cache(maxsize=1 << 14)
def solved(codes: str, x: int, y: int) -> tuple[str, ...]:
    return tuple(solve(codes, x, y))


def through(vector: Vector, block: tuple[Vector, ...]) -> tuple[Vector, list[int]]:
    """The vector after a block, and for each state the state before the block on its way."""
    found: list[tuple[int, tuple] | None] = [None] * 4
    come = [0] * 4
    for y in STATES:
        for x, (cost, place) in enumerate(vector):
            more, last = block[x][y]
            if cost < NEVER and more < NEVER:
                new = (cost + more, (place, last))
                if found[y] is None or new < found[y]:
                    found[y], come[y] = new, x
    return placed(found), come


def ended(vector: Vector) -> int:
    return min(STATES, key=lambda x: (vector[x][0] + INSERT * len(ENDS[x]), vector[x][1]))


def crossings(blocks: list[tuple[Vector, ...]]) -> tuple[list[int], int]:
    """The states before the first block, between blocks and after the last, and the cost of the search."""
    vector, trace = start(0), []
    for block in blocks:
        vector, come = through(vector, block)
        trace.append(come)
    states = [ended(vector)]
    for come in reversed(trace):
        states.append(come[states[-1]])
    return states[::-1], vector[states[0]][0] + INSERT * len(ENDS[states[0]])


# on the cluster


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32(conv_id:turn) % 20: 0 drops, 1 empties, 2 takes .!? away, 3 repeats, 4 makes it a user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of a table as it is."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", spaced("role"), spaced("text"), F.lit(1).cast("long").alias("copies"))


def first_seen(turn: str) -> Column:
    """Orders turns, nulls first."""
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copies, fault, code: a row for all that are alike, without texts."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    light = rows.select("conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("digest"), fault.alias("fault"), "copies")
    light = light.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    known = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), "digest", "role")
    light = light.withColumns({"alike": known, "salt": F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"), "_turn": first_seen("turn")})
    light = attach_groups(light, "alike", "salt", {"_least": F.min("_turn")}, {"_first": F.min("_least")})
    again = (F.col("fault").isNull() | (F.col("fault") == "truncated")) & (F.col("_turn") > F.col("_first"))
    light = light.withColumn("fault", F.when(again, "duplicate").otherwise(F.col("fault")))
    letter = F.left("role", F.lit(1))
    code = F.when(letter.isin(*LETTERS), letter).otherwise(OTHER)
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST).when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    return light.select("conv_id", "turn", "role", "digest", "copies", "fault", letter.alias("letter"), code.alias("code"))


def ordered(light: DataFrame) -> DataFrame:
    """The rows with seq, which grows with (conv_id, turn, role, digest) over all tasks, and block: BLOCK neighbours of a conversation at most."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    return dealt.withColumn("block", F.floor(F.col("seq") / BLOCK))


VECTORS = "array<array<struct<cost:long,place:int>>>"
BLOCKS = f"conv_id long, block long, first_seq long, codes string, copies array<long>, illegal long, first string, last string, transfer {VECTORS}"


def blocks_of(rows: DataFrame) -> DataFrame:
    """A row for each block of a conversation: its codes in order, neighbours that may not follow each other, and its vectors."""
    inside = F.sort_array(F.collect_list(F.struct("seq", "code", "letter", "copies"))).alias("r")
    blocks = rows.groupBy("conv_id", "block").agg(inside, F.min("seq").alias("first_seq")).select(
        "conv_id", "block", "first_seq", F.concat_ws("", "r.code").alias("codes"), F.col("r.copies").alias("copies"), F.col("r.letter").alias("letters"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("place", pa.int32())])))
        for batch in batches:
            illegal, first, last, vectors = [], [], [], []
            for codes, letters, copies in zip(*(batch.column(c).to_pylist() for c in ("codes", "letters", "copies")), strict=True):
                illegal.append(sum(not allowed(a, b) for a, b in zip(letters, letters[1:], strict=False)) + sum(copies) - len(copies))
                first.append(letters[0])
                last.append(letters[-1])
                vectors.append([[{"cost": c, "place": p} for c, p in v] for v in transfer(codes.replace(MUST, ""))])
            made = [pa.array(illegal, pa.int64()), pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(vectors, kind)]
            kept = ["conv_id", "block", "first_seq", "codes", "copies"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "illegal", "first", "last", "transfer"])

    return blocks.mapInArrow(work, BLOCKS)


def allowed(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


WAYS = "conv_id long, cost long, illegal long, ways array<struct<block:long,into:int,out:int,last:boolean>>"


def ways_of(blocks: DataFrame) -> DataFrame:
    """A row for each conversation: the search's cost, illegal neighbours, and the states before and after each block (one entry for BLOCK rows)."""
    parts = F.sort_array(F.collect_list(F.struct("block", "first", "last", "illegal", "transfer"))).alias("parts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("block", pa.int64()), ("into", pa.int32()), ("out", pa.int32()), ("last", pa.bool_())]))
        for batch in batches:
            costs, illegal, ways = [], [], []
            for conversation in batch.column("parts").to_pylist():
                states, cost = crossings([tuple(tuple((c["cost"], c["place"]) for c in v) for v in p["transfer"]) for p in conversation])
                between = sum(not allowed(a["last"], b["first"]) for a, b in zip(conversation, conversation[1:], strict=False))
                costs.append(cost)
                illegal.append(between + sum(p["illegal"] for p in conversation))
                end = len(conversation) - 1
                ways.append([{"block": p["block"], "into": states[i], "out": states[i + 1], "last": i == end} for i, p in enumerate(conversation)])
            made = [pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(ways, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made], ["conv_id", "cost", "illegal", "ways"])

    return blocks.groupBy("conv_id").agg(parts).mapInArrow(work, WAYS)


EDITS = "conv_id long, block long, first_seq long, edits array<string>, audit string"


def edits_of(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """The edits of each row of each block, in order, and the block's part of the audit."""
    each = ways.select(F.col("conv_id").alias("_conv"), F.explode("ways").alias("way")).select("_conv", F.col("way.block").alias("_block"), "way.into", "way.out", F.col("way.last").alias("ends"))
    both = blocks.join(each, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, audits = [], []
            for codes, copies, x, y, ends in zip(*(batch.column(c).to_pylist() for c in ("codes", "copies", "into", "out", "ends")), strict=True):
                found = iter(solved(codes.replace(MUST, ""), x, y))
                rows = ["D" if c == MUST else next(found) for c in codes]
                tail = ENDS[y] if ends else ""
                edits.append([*rows[:-1], rows[-1] + tail])
                audits.append("".join(e + "D" * (n - 1) for e, n in zip(rows, copies, strict=True)) + tail)
            kept = ["conv_id", "block", "first_seq"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(edits, pa.list_(pa.string())), pa.array(audits)], [*kept, "edits", "audit"])

    return both.select("conv_id", "block", "first_seq", "codes", "copies", "into", "out", "ends").mapInArrow(work, EDITS)


def repaired_rows(edits: str, state: int, role: str, text: str) -> tuple[list[tuple[str, str]], int]:
    """What a row's edits leave: (role, text) of each row that stands there, and the state after them."""
    out = []
    for edit in edits:
        if edit in "IR":
            out.append((GIVES[state], "" if edit == "I" else text))
            state = NEXT[state]
        elif edit == "K":
            out.append((role, text))
            state = AFTER[state][role[0]]
    return out, state


def repaired(rows: DataFrame, edited: DataFrame, digests: bool) -> DataFrame:
    """The repaired conversations: their rows (conv_id, place, role, text), or one digest for each.

    Edits and texts of a conversation are sorted together, each row's edits before its
    copies, and streamed: nothing of it is held but the running state.
    """
    columns = "conv_id long, turn long, role string, digest string, seq long, edits string, text string"
    marks = edited.select("conv_id", "turn", "role", "digest", "seq", "edits", F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("digest"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("edits"), "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = marks.unionByName(texts).repartition(n, "conv_id").sortWithinPartitions(*order, F.col("edits").asc_nulls_last())
    schema = "conv_id long, repaired_sha256 string" if digests else "conv_id long, place long, role string, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, place, chain, edits = None, 0, 0, None, None
        names = [c.split()[0] for c in columns.split(", ")]
        for batch in batches:
            out = []
            for conv, _, role, _, _, mark, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if chain is None or conv != now:
                    if chain is not None and digests:
                        out.append((now, chain.hexdigest()))
                    now, state, place, chain = conv, 0, 0, hashlib.sha256()
                if mark is not None:
                    edits = mark
                elif edits is not None:  # the first of the copies; the others go
                    made, state = repaired_rows(edits, state, role, text)
                    edits = None
                    for said in made:
                        if digests:
                            chain.update(("\n" if place else "").encode() + f"{said[0]}:{said[1]}".encode("utf-8", "surrogatepass"))
                        else:
                            out.append((conv, place, *said))
                        place += 1
            if out:
                yield batch_of(out)
        if chain is not None and digests:
            yield batch_of([(now, chain.hexdigest())])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string()] if digests else [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return stream.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(work, schema)


def searched(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The ordered rows with their edits, the ordered rows, the blocks' edits, and a row for each conversation (cost of the search, illegal)."""
    small_batches(rows.sparkSession)
    light = stored(coded(rows), "coded-turns")
    lined = stored(ordered(light), "ordered-turns")
    blocks = stored(blocks_of(lined), "turn-blocks")
    ways = stored(ways_of(blocks), "turn-ways")
    edits = stored(edits_of(blocks, ways), "turn-edits")
    mine = edits.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "first_seq", F.col("edits").alias("_edits"))
    joined = lined.join(mine, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    edited = joined.select(*lined.columns, F.element_at("_edits", (F.col("seq") - F.col("first_seq") + 1).cast("int")).alias("edits"))
    return edited, lined, edits, ways.select("conv_id", "cost", "illegal")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations."""
    rows = typed(plain(conversations))
    return repaired(rows, searched(rows)[0], digests=False)


def typed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})


def report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conv_id of `every`: counts, cost, audit and digest of the repaired conversation."""
    rows = typed(rows)
    edited, lined, edits, ways = searched(rows)
    # alike rows beyond the first are duplicates, unless they are blank
    first = lambda name, extra: F.sum(F.when(F.col("fault") == name, 1).otherwise(0) * extra)
    more = F.when(F.coalesce(F.col("fault"), F.lit("truncated")) == "truncated", F.col("copies") - 1).otherwise(0)
    counts = lined.groupBy("conv_id", "turn").agg(
        first("blank", F.col("copies")).alias("blank"), (first("duplicate", F.col("copies")) + F.sum(more)).alias("duplicate"), first("truncated", F.lit(1)).alias("truncated"))
    turns = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = counts.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    audits = edits.groupBy("conv_id").agg(F.concat_ws("", F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"]).alias("audit"))
    digests = repaired(rows, edited, digests=True)
    out = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (counts, ways, audits, digests):
        renamed = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(renamed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    cost = F.coalesce(F.col("cost") + DELETE * (F.col("blank") + F.col("duplicate")), F.lit(0)).cast("long").alias("cost")
    return out.select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), cost,
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return report(damaged(conversations), conversations)


#: The search over all rows one by one, for each conversation the four best audits so far.
ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS n)),
source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
        [4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc_table),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM source, (SELECT unnest(range(2)) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
lined AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
seen AS (
    SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS is_cut,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM lined),
faults AS (
    SELECT conv_id, turn, role, text, i, CASE WHEN is_blank THEN 'blank' WHEN again THEN 'duplicate' WHEN is_cut THEN 'truncated' ELSE '' END AS fault, pair FROM seen),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id),
gives(x, y, gives) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
keeps(x, y, letter) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
inserts AS (
    SELECT x, x AS y, 0 AS cost, '' AS edits, []::VARCHAR[] AS said FROM gives
    UNION ALL
    SELECT inserts.x, gives.y, cost + 5, edits || 'I', list_append(said, gives || ':') FROM inserts JOIN gives ON inserts.y = gives.x WHERE cost < 15),
ways AS (
    SELECT conv_id, f.i, n.x, n.y, n.cost + 2 AS cost, n.edits || 'D' AS edits, n.said FROM faults AS f, inserts AS n
    UNION ALL
    SELECT conv_id, f.i, n.x, k.y, n.cost + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, n.edits || 'K', list_append(n.said, f.role || ':' || f.text)
    FROM faults AS f, inserts AS n JOIN keeps AS k ON n.y = k.x WHERE fault IN ('', 'truncated') AND k.letter = left(f.role, 1)
    UNION ALL
    SELECT conv_id, f.i, n.x, g.y, n.cost + 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, n.edits || 'R', list_append(n.said, gives || ':' || f.text)
    FROM faults AS f, inserts AS n JOIN gives AS g ON n.y = g.x WHERE fault IN ('', 'truncated')),
best_ways AS (SELECT conv_id, i, x, y, min({'cost': cost, 'edits': edits, 'said': said}) AS way FROM ways GROUP BY ALL),
search AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS x, {'cost': 0, 'audit': '', 'said': []::VARCHAR[]} AS best FROM counts
    UNION ALL
    SELECT s.conv_id, w.i, w.y, min({'cost': s.best.cost + w.way.cost, 'audit': s.best.audit || w.way.edits, 'said': s.best.said || w.way.said})
    FROM search AS s JOIN best_ways AS w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.i + 1 AND w.x = s.x GROUP BY s.conv_id, w.i, w.y),
ends AS (
    SELECT s.conv_id, min({'cost': s.best.cost + n.cost, 'audit': s.best.audit || n.edits, 'said': s.best.said || n.said}) AS best
    FROM search AS s JOIN inserts AS n USING (x) JOIN (SELECT conv_id, max(i) AS i FROM faults GROUP BY conv_id) AS l ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.i = l.i
    WHERE n.y IN (0, 3) GROUP BY s.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS e LEFT JOIN counts AS c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends AS b ON e.conv_id IS NOT DISTINCT FROM b.conv_id
"""

by_value(__name__)
