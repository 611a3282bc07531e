"""Harmonic packing: every id once, gapless sequences, no padding, a fixed count for each class."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_checks import SF_SMALL
from llm_rows import prose

from quillstone.llm import harmonic, packing


def packed(lengths, capacity=1024, waiting=8):
    worker = harmonic.Worker(capacity, waiting)
    for i, n in enumerate(lengths):
        worker.add((i, n), np.arange(n, dtype="<u4"))
        assert len(worker.waiting) <= waiting + 1 and len(worker.open) <= 2 * int(capacity ** 0.5)
    before = list(worker.done)
    worker.finish()
    return before, worker.done


@pytest.mark.parametrize("case", range(8))
def test_every_id_once_and_no_padding(case):
    rng = random.Random(case)
    lengths = [
        [rng.randrange(1, 3000) for _ in range(800)], [600] * 500, [1] * 5000, [1024, 2048, 1025, 1], [342] * 700, [],
        [rng.randrange(1, 40) for _ in range(3000)], [rng.choice([513, 1023, 100_000]) for _ in range(60)],
    ][case]
    _, done = packed(lengths)
    ids = defaultdict(list)
    for sequence in done:
        total = sum(len(p[2]) for p in sequence)
        assert total == 1024 or total < 1024 and total & (total - 1) == 0
        for (doc, n), start, piece in sequence:
            assert n == lengths[doc] and piece[0] == start
            ids[doc].append(piece)
    for doc, n in enumerate(lengths):
        assert np.array_equal(np.sort(np.concatenate(ids[doc])), np.arange(n))
    assert sum(sum(len(p[2]) for p in s) < 1024 for s in done) <= 10


def test_a_class_has_a_fixed_count():
    """Documents of one class, nothing cut: j in each sequence, and the last piece is the head of a later document."""
    for n in (600, 400, 300, 90, 17):
        count = 1024 // n
        before, _ = packed([n] * 5000, waiting=8)
        whole = [[p for p in s if len(p[2]) == n] for s in before]
        assert sum(len(w) >= count for w in whole) > 0.5 * len(before)


def test_few_cuts():
    rng = random.Random(3)
    lengths = [int(rng.lognormvariate(5.5, 1.2)) + 1 for _ in range(5000)]
    _, done = packed(lengths)
    pieces = sum(len(harmonic.joined(s)) for s in done)
    assert pieces <= len(lengths) + 1.1 * len(done)


def test_pieces_match_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in harmonic.op11_harmonic_packing(spark, SF_SMALL).collect():
        assert zlib.crc32(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, parts in pieces.items():
        assert [s for s, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) == len(ids[doc])
    assert set(pieces) == set(ids)
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]
        total = sum(n for _, n in parts)
        assert total == 1024 or total & (total - 1) == 0


def test_whole_sequences_round_trip(spark):
    docs = spark.createDataFrame([(i, prose(i, n)) for i, n in enumerate([5, 900, 3000, 1, 0, 200, 700])] + [(9, None)], "doc_id long, text string").coalesce(1)
    out = harmonic.pack(docs).cache()
    ids = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.sequences(out).collect()}
    encode = packing.encoder(packing.vocabulary_path())
    for doc, text in docs.collect():
        parts = sorted((r["start"], r["sequence_id"], r["offset"], r["length"]) for r in out.where(f"doc_id = {doc}").collect())
        assert np.concatenate([ids[s][o:o + n] for _, s, o, n in parts]).tolist() == [*encode(text or "").tolist(), 0]


def test_edges(edge_docs, make):
    rows = harmonic.pack(edge_docs).collect()
    assert sum(r["start"] == 0 for r in rows) == edge_docs.count()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in edge_docs.select("doc_id").collect()}
    assert harmonic.pack(make([])).count() == 0
