"""The pipeline's stages against brute force, and on edge cases."""

import numpy as np
import pytest
from llm_checks import SF_SMALL
from llm_rows import prose

import corpus_pipeline
from quillstone.llm import decontamination, packing, simhash
from quillstone.llm.common import stored

STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_names_and_order():
    assert [n.split("_")[0] for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "simhash", "benchmark", "best"]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, now = docs.columns, docs
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}

    now = stored(STAGES["language_id"](spark, now, SF_SMALL), "t1")
    rows = {d: t for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    assert now.columns == columns and ids(now) == sorted(rows)

    now = stored(STAGES["exact_dedup"](spark, now, SF_SMALL), "t2")
    last = {}
    for d, t in sorted(rows.items()):
        last[t] = d
    rows = {d: t for t, d in last.items()}
    assert now.columns == columns and ids(now) == sorted(rows)

    now = stored(STAGES["simhash_near_dedup"](spark, now, SF_SMALL), "t3")
    order = sorted(rows)
    prints = np.array([simhash.fingerprint_of(rows[d]) for d in order], np.int64).view(np.uint64)
    group = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if bin(int(prints[i] ^ prints[j])).count("1") <= 4:
                old, new = sorted((group[i], group[j]), reverse=True)
                group = [new if g == old else g for g in group]
    rows = {order[g]: rows[order[g]] for g in set(group)}
    assert now.columns == columns and ids(now) == sorted(rows)

    now = stored(STAGES["benchmark_decontamination"](spark, now, SF_SMALL), "t4")
    items = [" ".join(decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = {d: t for d, t in rows.items() if not any(i in " ".join(decontamination.words_of(t)) for i in items)}
    assert now.columns == columns and ids(now) == sorted(rows)

    packed = STAGES["best_fit_packing"](spark, now, SF_SMALL).collect()
    encode = packing.encoder(packing.vocabulary_path())
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {d: len(encode(t)) + 1 for d, t in rows.items()}

    whole = corpus_pipeline.run(spark, SF_SMALL).collect()
    place = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(place, whole)) == sorted(map(place, packed))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_edges(spark, edge_docs, make, name):
    out = STAGES[name](spark, edge_docs, SF_SMALL)
    if name != "best_fit_packing":
        assert out.columns == edge_docs.columns
    assert out.count() > 0
    assert STAGES[name](spark, make([]), SF_SMALL).count() == 0


def test_hot_groups_end_as_one_document(spark, make):
    near = prose(9, 300).split()
    rows = [(i, prose(8, 120), *(None,) * 10) for i in range(600)]
    for i in range(60):
        words = list(near)
        words[i] = f"x{i}"
        rows.append((1000 + i, " ".join(words), *(None,) * 10))
    kept = STAGES["exact_dedup"](spark, make(rows), SF_SMALL)
    assert ids(kept) == [599, *range(1000, 1060)]
    prints = {i: simhash.fingerprint_of(t) for i, t, *_ in rows}
    kept = ids(STAGES["simhash_near_dedup"](spark, make(rows), SF_SMALL))
    assert 0 in kept and len([k for k in kept if k < 1000]) == 1
    assert len(kept) < 1 + len({prints[i] for i in range(1000, 1060)}) or len({prints[i] for i in range(1000, 1060)}) == 1
