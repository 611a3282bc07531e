"""Conversation repair against whole-string dynamic programming, its SQL and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from llm_checks import SF_SMALL, compare
from pyspark.sql import functions as F

from quillstone.llm import conversation_repair as repair

KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVES = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault), by carrying whole strings through every single edit."""
    now = {0: (0, "", [])}

    def inserted(states):
        for _ in range(4):
            for x, (cost, audit, said) in list(states.items()):
                role, y = GIVES[x]
                states[y] = min(states.get(y, (10**9,)), (cost + 5, audit + "I", [*said, f"{role}:"]))
        return states

    for role, text, fault in rows:
        after = {}
        for x, (cost, audit, said) in inserted(now).items():
            ways = [(x, cost + 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                given, y = GIVES[x]
                ways.append((y, cost + 1 + more, "R", [f"{given}:{text}"]))
                if (x, role[:1]) in KEEPS:
                    ways.append((KEEPS[x, role[:1]], cost + more, "K", [f"{role}:{text}"]))
            for y, c, edit, line in ways:
                after[y] = min(after.get(y, (10**9,)), (c, audit + edit, said + line))
        now = after
    return min(v for x, v in inserted(now).items() if x in (0, 3))


def faults(rows):
    """(role, text, fault) of rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(table):
    """The contract over rows (conv_id, turn, role, text), in plain Python."""
    after = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.sha256(text.encode()).hexdigest(), text)
        after[conv] += [row] * (2 if kind == 3 else 1)
    out = []
    for conv in {r[0] for r in table}:
        rows = sorted(after[conv])
        turns = {r[1] for r in rows if r[0]}
        found = faults([(r[2], r[4]) for r in rows])
        pairs = [a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False)]
        cost, audit, said = cheapest(found)
        count = lambda name: sum(f[2] == name for f in found)  # noqa: E731, B023
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), sum(pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def got(spark, table):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    return [tuple(r) for r in repair.report(repair.damaged(df), df).collect()]


def same(a, b):
    key = lambda r: (r[0] is not None, r[0])
    assert sorted(a, key=key) == sorted(b, key=key)


def chatter(seed, conversations, turns, nulls=False):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "u2"] + [None] * nulls
    texts = ["Yes.", "No!", "cut off", "  ", "", "what?  \n", "a.b", "é", "x" * 50 + "."] + [None] * nulls
    return [
        (None if nulls and c == 0 else c, None if nulls and rng.random() < 0.1 else t * rng.choice([1, 1, 1, 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.")
        for c in range(conversations) for t in range(rng.randrange(turns))
    ]


def test_query_equals_its_sql(spark):
    compare(repair.op12_conversation_repair(spark, SF_SMALL), repair.ORACLE_SQL)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_equals_brute_force(spark, monkeypatch, block):
    """Many short conversations, and blocks of few rows, so that most meet between blocks."""
    monkeypatch.setattr(repair, "BLOCK", block)
    table = chatter(block, 150, 14)
    same(got(spark, table), brute(table))


def test_halves_meet_where_whole_strings_say():
    """Edits of code strings, by halves and by blocks, equal the search that carries strings."""
    rng = random.Random(7)
    text = {"s": ("system", "."), "u": ("user", "."), "a": ("assistant", "."), "o": ("tool", "."), "S": ("system", "t"), "U": ("user", "t"), "A": ("assistant", "t"), "O": ("tool", "t")}
    for _ in range(400):
        codes = "".join(rng.choice("uuaaasoUAS") for _ in range(rng.randrange(1, 24)))
        cost, audit, _ = cheapest([(*text[c], "truncated" if c.isupper() else "") for c in codes])
        end = repair.ended(repair.forward(repair.start(0), codes))
        assert "".join(repair.solve(codes, 0, end)) + repair.ENDS[end] == audit
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(3))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        states, total = repair.crossings([repair.transfer(p) for p in parts])
        joined = "".join("".join(repair.solve(p, states[i], states[i + 1])) for i, p in enumerate(parts))
        assert (total, joined + repair.ENDS[states[-1]]) == (cost, audit)


def test_memory_is_linear():
    """A conversation of 200,000 rows is solved by halves without a table of its rows by states."""
    codes = "suauaUAoua" * 4000
    end = repair.ended(repair.forward(repair.start(0), codes))
    edits = repair.solve(codes, 0, end)
    assert len(edits) == len(codes) and sum(e.endswith("K") for e in edits) > 0.5 * len(codes)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """A conversation with most of all rows is dealt over tasks and blocks; a thousand copies of one row are one row with a count."""
    monkeypatch.setattr(repair, "BLOCK", 64)
    table = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 700}.") for t in range(3000)] + [(2, 5, "user", "Same.")] * 1000 + [(3, 0, "user", "a."), (3, 1, "assistant", "b.")]
    same(got(spark, table), brute(table))
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    light = repair.coded(repair.typed(repair.plain(df)))
    assert light.where("conv_id = 2").count() == 1 and light.where("conv_id = 2").first()["copies"] == 1000
    lined = repair.ordered(light).groupBy("conv_id", "block").count()
    assert lined.agg(F.max("count")).first()[0] <= 64 and lined.where("conv_id = 1").count() >= 3000 // 64


def test_repaired_rows(spark):
    """The operator itself: rows that alternate, without damage."""
    rows = [(1, 0, "user", "Hi.", 0), (1, 1, "user", "Hi.", 0), (1, 2, "tool", "Yes.", 0), (1, 3, "user", " ", 0), (2, 0, "assistant", "cut", 0), (3, 0, "system", "Be.", 0), (3, 1, "user", "So?", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")
    out = [tuple(r) for r in repair.repair(df).orderBy("conv_id", "place").collect()]
    assert out == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (3, 0, "user", "Be."), (3, 1, "assistant", "So?")]


def test_edges(spark):
    """Nulls in every column, ties, repeated rows, an empty table, very long texts."""
    table = chatter(11, 40, 9, nulls=True)
    table += table[:30] + [(None, None, None, None), (77, None, "user", "y" * 300_000 + "."), (77, None, "assistant", "z."), (78, 0, "user", "a"), (78, 0, "user", "b")]
    same(got(spark, table), brute(table))
    assert got(spark, []) == []
