"""Exact dedup, SimHash near-dedup, sharding and the license scan: against SQL or brute force."""

import hashlib
import random

import numpy as np
import xxhash

from quillstone.llm import exact_dedup, license_scan, sharding, simhash
from llm_checks import SF_SMALL, compare
from llm_rows import prose
from pyspark.sql import functions as F


def test_exact_dedup_matches_sql(spark):
    compare(exact_dedup.op9_exact_dedup(spark, SF_SMALL), exact_dedup.ORACLE_SQL)


def test_exact_dedup_edges(edge_docs, make):
    rows = exact_dedup.classify(edge_docs, exact_dedup.new_index(edge_docs.sparkSession)).collect()
    assert len(rows) == edge_docs.count()
    empty = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {2} and {r["group_size"] for r in empty} == {3}
    copies = [r for r in rows if r["doc_id"] in (0, 7)]
    assert {r["keep_id"] for r in copies} == {7} and {r["group_size"] for r in copies} == {4}
    kept = exact_dedup.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == edge_docs.selectExpr("coalesce(text, '')").distinct().count()
    assert exact_dedup.deduplicate(make([])).count() == 0
    assert exact_dedup.classify(make([]), exact_dedup.new_index(edge_docs.sparkSession)).count() == 0


def test_digest_index_persists_and_does_not_grow_on_retry(spark, make):
    index = exact_dedup.new_index(spark)
    first = make([(i, f"text {i}", *(None,) * 10) for i in range(20)])
    assert exact_dedup.deduplicate(first, index).count() == 20
    spark.sql(f"DROP TABLE {index.name}")
    again = exact_dedup.DigestIndex(spark, index.path, index.name)
    second = make([(100 + i, f"text {10 + i}", *(None,) * 10) for i in range(20)])
    assert sorted(r[0] for r in exact_dedup.deduplicate(second, again).select("doc_id").collect()) == list(range(110, 120))
    assert again.table().count() == 30
    again.add(second.selectExpr("sha2(text, 256) digest", "doc_id keep_id"))
    assert again.table().count() == 30
    plan = first.selectExpr("sha2(text, 256) digest").hint("merge").join(again.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(fps, ids, bits=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    array = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= bits) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r["doc_id"]: r for r in simhash.op10_simhash_near_dedup(spark, SF_SMALL).collect()}
    fps = [fingerprint(t) for t in docs["text"]]
    expected = brute_components(fps, docs["doc_id"].tolist())
    assert len(got) == len(docs)
    for i, doc in enumerate(docs["doc_id"].tolist()):
        assert got[doc]["fingerprint"] == f"{fps[i]:016x}"
        assert got[doc]["component_id"] == expected[i]


def test_fingerprint_words_are_ascii_space_only():
    for text in ("A b C\x1cd\x85e f\x0bg", "Ä É ß", "one two", "\t\n", None, "a b c d e f a b c d e f"):
        assert simhash.fingerprint_of(text) & (2**64 - 1) == fingerprint(text)


def test_trie_join_matches_brute_force(spark):
    """Clusters and chains of near fingerprints among random ones, over several top nodes and units."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(2500)}
    for _ in range(120):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(2, 9)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                v ^= 1 << b
            fps.add(v)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.links(classes, len(fps))
    roots = {r["node"]: r["root"] for r in simhash.components(links.selectExpr("fp u", "root v")).collect()}
    expected = brute_components(fps, signed)
    assert [roots.get(s, s) for s in signed] == expected


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_simhash_edges(edge_docs, make):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[7] == 0 and by_id[2] == 1 and by_id[3] == 1
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.one_of_each(make([])).count() == 0


def test_license_scan_matches_sql(spark):
    compare(license_scan.op1_license_scan(spark, SF_SMALL), license_scan.ORACLE_SQL)


def test_license_scan_of_planted_lines(spark, tmp_path):
    line = "This work is licensed under the GNU Lesser General Public License, version 3."
    texts = [
        line, "x " * 500 + line + " y" * 300, "Released under the\nMIT License.", "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
        "licensed under the gnu general public license v3", None, "", "!!", "ΆBC ünder-the", "under the mit license under the mit license", "the license of the river", "x" * 100_000 + " " + "the " * 50_000,
        "Permission is hereby granted, free of charge, to anybody obtaining a copy of this software and associated documentation files",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, line), (0, line)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = license_scan.op1_license_scan(spark, str(tmp_path))
    compare(got, license_scan.ORACLE_SQL, {"documents": f"{tmp_path}/documents.parquet/*.parquet"})
    labels = {r["doc_id"]: r["labels"] for r in got.collect()}
    assert labels[0] == labels[1] == "lgpl-3" and labels[2] == "mit" and labels[3] == "apache-2,cc-by-nc" and labels[10] == labels[11] == "" and labels[12] == "mit"


def test_whole_license_texts(spark, tmp_path):
    """Full texts, changed here and there, anywhere in a text: found as a whole, wherever a block begins."""
    whole = {label: text.split() for label, text in license_scan.TEMPLATES if len(text.split()) > license_scan.SHORT}
    assert set(whole) == {"mit", "isc", "bsd"} and all(len(w) > 100 for w in whole.values())
    rng, rows, expected = random.Random(4), [], {}
    for i in range(24):
        label = rng.choice(sorted(whole))
        words = [w if rng.random() > 0.05 else f"other{i}" for w in whole[label]][8:]  # its first line is gone
        rows.append((i, f"{prose(i, rng.randrange(500))} {' '.join(words)} {prose(i + 50, rng.randrange(500))}"))
        expected[i] = label
    rows += [(100 + i, f"{prose(i, 300)} {' '.join(whole['mit'][:60])}") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = license_scan.op1_license_scan(spark, str(tmp_path))
    compare(got, license_scan.ORACLE_SQL, {"documents": f"{tmp_path}/documents.parquet/*.parquet"})
    labels = {r["doc_id"]: r["labels"].split(",") for r in got.collect()}
    assert all(label in labels[i] for i, label in expected.items())
    _, matches = license_scan.scan(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert matches.where("half > 100").select("_row").distinct().count() == 24  # a third of a text is no match


def test_templates_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_INDEX", 1)
    compare(license_scan.op1_license_scan(spark, SF_SMALL), license_scan.ORACLE_SQL)


def test_sharding_matches_sql(spark):
    compare(sharding.op4_sharding(spark, SF_SMALL), sharding.ORACLE_SQL)


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names, 4099)
    counts = [table.count(n) for n in names]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != "s19")
    assert moved < 0.25 * 4099
    weighted = sharding.lookup_table(["a", "b"], 997, [3, 1])
    assert abs(weighted.count("a") - 3 * weighted.count("b")) <= 4


def test_heavy_keys_are_spread(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id)) key", "'old' slot", "'old' shard")
    names = [f"s{i}" for i in range(8)]
    placed = sharding.place(rows, sharding.spread(rows, "key", rows["id"], 8), names).where("key = 'hot'")
    assert placed.columns.count("slot") == 1 and placed.select("shard").distinct().count() > 1
    assert sharding.place(rows.where("id < 0"), rows["key"], names).count() == 0


def test_sharding_edges(edge_docs, make):
    names = [f"s{i}" for i in range(8)]
    placed = sharding.place(edge_docs, edge_docs["doc_id"], names)
    assert placed.count() == edge_docs.count() and placed.where("shard is null").count() == 0
    assert placed.where("doc_id = 0").select("shard").distinct().count() == 1


def test_near_copies_that_share_an_id(spark):
    """Different texts of one doc_id: the row that its own component drops goes, although the id is another component's smallest."""
    a, b = prose(901, 200), prose(902, 200)
    docs = spark.createDataFrame([(5, a), (9, a + " end"), (5, b), (3, b), (None, prose(903, 100))], "doc_id long, text string")
    assert sorted(simhash.one_of_each(docs).collect(), key=str) == sorted(docs.where(F.col("doc_id").isNull() | (F.col("doc_id") == 3) | ((F.col("doc_id") == 5) & (F.col("text") == a))).collect(), key=str)


def test_the_same_row_of_repeated_ids_stays(spark):
    rows = [(1, "same", f"s{i}", {"k": i}) for i in range(40)]
    kept = [exact_dedup.deduplicate(spark.createDataFrame(r, "doc_id long, text string, source string, m map<string,int>").repartition(n)).collect() for r, n in ((rows, 3), (rows[::-1], 7))]
    assert kept[0] == kept[1] and len(kept[0]) == 1
