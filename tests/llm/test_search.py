"""Ranked lexical search against its SQL, brute force and odd inputs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_checks import SF_SMALL, compare
from llm_rows import prose

from quillstone.llm import lexical_search as search

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """Every document against every item, in plain Python."""
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n, total = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(words(t))
    out = []
    for item, terms in queries.items():
        found = []
        for d, c in bags:
            m = 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return out


def rows(df):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


def same(got, expected):
    key = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_query_equals_its_sql(spark):
    compare(search.op13_ranked_search(spark, SF_SMALL), search.ORACLE_SQL)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_over_many_small_shards(spark, monkeypatch, seed):
    """Shards of few documents, small batches of ranges, blocks of few items, ties by copies."""
    for name, value in (("DOCS", 7), ("BATCH", 3), ("ITEMS", 4), ("SEEDS", 2)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(seed)
    docs = [(i, prose(rng.randrange(40), rng.randrange(1, 60))) for i in range(150)]
    items = [(i, prose(100 + i, rng.randrange(1, 12))) for i in range(11)]
    got = search.searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 9)
    same(rows(got), brute(docs, items, 9))


def test_treap_cells_and_maxima():
    """Every cell that a row path reaches holds its largest impact; the last level holds the impacts."""
    rng = np.random.default_rng(5)
    grid, bags = search.Grid(), []
    for i in range(37):
        bags.append(Counter({f"t{t}".encode(): int(rng.integers(1, 9)) for t in rng.integers(0, 90, 12)}))
        grid.add(i, bags[-1])
    stats = search.Statistics(37, sum(b.total() for b in bags))
    treap = search.Treap(grid.treap(0, stats).to_pylist()[0])
    impacts = {(t, int(treap.ids[c])): None for t in treap.row_of for c in range(37)}
    for term, row in treap.row_of.items():
        cells, columns = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(treap.depth):
            side = ((row >> (treap.depth - 1 - level)) & 1) * 2
            kids = [(c * 2 + h, int(treap.first[level][n]) + bin(treap.masks[level][n] & ((1 << (side + h)) - 1)).count("1"))
                    for c, n in zip(columns, cells, strict=True) for h in (0, 1) if treap.masks[level][n] >> (side + h) & 1]
            columns, cells = (np.array(x) for x in zip(*kids, strict=True))
        for c, n in zip(columns, cells, strict=True):
            impacts[term, int(treap.ids[c])] = int(treap.best[-1][n])
    for i, bag in enumerate(bags):
        for term in treap.row_of:
            expected = int(search.impact(np.array([bag[term]]), np.array([bag.total()]), stats)[0]) if term in bag else None
            assert impacts[term, i] == expected
    for level in range(1, treap.depth + 1):
        assert treap.best[level][:-1].max() == treap.best[0][0]


def test_ranges_are_dropped(monkeypatch):
    """A rare term's documents are found without opening the others' ranges."""
    monkeypatch.setattr(search, "BATCH", 16)
    grid = search.Grid()
    for i in range(4096):
        grid.add(i, Counter([b"common", b"rare"] if i % 1000 == 7 else [b"common", f"own{i}".encode()]))
    treap = search.Treap(grid.treap(0, search.Statistics(4096, 8192)).to_pylist()[0])
    seen = []
    ones = search._ONES

    class Watched:
        def __getitem__(self, at):
            seen.append(np.size(at))
            return ones[at]

    monkeypatch.setattr(search, "_ONES", Watched())
    columns, _ = treap.top([(b"rare", 7000), (b"common", 1)], 5, 0)
    assert sorted(treap.ids[columns]) == [7, 1007, 2007, 3007, 4007] and sum(seen) < 2048


def test_terms_of_odd_texts():
    for text in ("Éa-b_C9 ß x\x7fy", "", None, " .,", "A" * 10, "naïve İI", "x\x00y"):
        assert search.counted(text) == Counter(w.encode() for w in words(text))
        assert search.length_of(text) == len(words(text))


def test_long_texts_in_pieces(monkeypatch):
    text = prose(3, 5000) + "." + "é" * 5000 + " end"
    whole = search.counted(text)
    monkeypatch.setattr(search, "PIECE", 50)
    assert search.counted(text) == whole and search.length_of(text) == whole.total()


def test_search_edges(edge_docs, make, spark):
    """Nulls in every column, repeated rows and ids, items that share an id or have no known term, empty tables."""
    schema = "item_id long, text string, score long, rank int"
    items = [(1, prose(2, 6), 0, 0), (1, prose(3, 5), 0, 0), (None, "stone", 0, 0), (None, None, 0, 0), (2, None, 0, 0), (3, "zzzz qqqq", 0, 0), (4, "", 0, 0)]
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    same(rows(search.searched(edge_docs, spark.createDataFrame(items, schema), 5)), brute(docs, [i[:2] for i in items], 5))
    assert search.searched(edge_docs, spark.createDataFrame([], schema)).count() == 0
    assert search.searched(make([]), spark.createDataFrame(items, schema)).count() == 0
