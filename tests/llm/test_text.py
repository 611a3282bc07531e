"""Language ID, personal data, quality, decontamination, packing and chat formatting: brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_checks import SF_SMALL, compare
from pyspark.sql import functions as F

from llm_rows import prose
from quillstone.llm import chat_format, decontamination, language_id, packing, privacy, quality

SF = "/root/testdata/sf0.01"


# language ID

def test_language_held_out_accuracy(spark):
    got = language_id.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_profiles_match_a_plain_bundle():
    text = "Über, the river 12 été\nriver!!"
    grams = language_id.Grams()
    got = language_id.profiles([grams.counted(text)], 3, 256)[0]
    clean = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    expected = np.zeros(256)
    for i in range(len(clean) - 2):
        bound = np.ones(256)
        for j, letter in enumerate(clean[i:i + 3]):
            bound *= np.roll(language_id.letter_vectors(np.array([ord(letter)]), 256)[0], 2 - j)
        expected += bound
    assert np.array_equal(got, expected)


def test_language_pieces_of_long_texts(monkeypatch):
    text = prose(3, 3000)
    whole = language_id.Grams().counted(text)
    monkeypatch.setattr(language_id, "PIECE", 500)
    pieces = language_id.Grams().counted(text)
    assert np.array_equal(whole[0], pieces[0])
    # a piece's edges add the spaces that a word's end has anyway
    assert abs(int(whole[1].sum()) - int(pieces[1].sum())) <= 2 * len(text) // 500


def test_unlabelled_texts_stay(edge_docs, make):
    """Without labels outside fold 1 the stage keeps every text with a letter."""
    docs = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = language_id.identified_only(docs)
    assert kept.columns == docs.columns and kept.count() == docs.where("text rlike '\\\\p{L}'").count() > 0


def test_language_edges(edge_docs, make):
    languages, prototypes = language_id.train(edge_docs)
    assert languages == ["en"]
    got = [tuple(r) for r in edge_docs.select("doc_id", language_id.identify(edge_docs["text"], languages, prototypes)["lang"]).collect()]
    assert {d: p for d, p in got if d is not None} == {0: "en", 1: "und", 2: "und", 3: "und", 4: "und", 5: "en", 6: "en", 7: "en", 8: "en", 9: "en"}
    kept = language_id.identified_only(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.where("text rlike '\\\\p{L}'").count()
    empty = language_id.train(make([]))
    assert empty[0] == []
    assert edge_docs.select(language_id.identify(edge_docs["text"], *empty)["lang"].alias("p")).distinct().collect()[0]["p"] == "und"
    assert language_id.identified_only(make([])).count() == 0


def test_kept_languages_and_least_score(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    every = language_id.identified_only(docs).count()
    english = language_id.identified_only(docs, ["en"])
    assert 0 < english.count() < every == docs.where("text rlike '\\\\p{L}'").count()
    assert english.where("lang <> 'en'").count() <= 0.05 * english.count()
    assert language_id.identified_only(docs, least=0.9).count() < every and language_id.identified_only(docs, ["xx"]).count() == 0


# personal data

def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(only(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


TRICKY = [
    "a@b.c_d@e.f@g.h x@y é@z.de a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 999999999999.1.1.1", "4111 1111-1111 1111 4111111111111111x 41111111111111112222 1-2 3",
    "+1 (988) 555-2485 +12 +1234567 +12345678. ++1 23 45 67 89 + 1", "9" * 5000, "a" * 5000, "1." * 2000, "😀 a@b.co 😀 1.2.3.4", "+1" + " " * 3000 + "2", "", None, "@.@", "é" * 10 + "4111111111111111",
    "1.2.3.4 " * 700, "x@y.z " * 700,
]


def test_patterns_match_python(spark, tmp_path):
    rng = random.Random(3)
    alphabet = "a@.1+-( )9é_"
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in privacy.op5_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        expected = plain_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest(), text
        assert got[i]["n_email"] + got[i]["n_ip"] + got[i]["n_card"] + got[i]["n_phone"] == expected.count(":") // 2


def test_disclosing_terms(spark):
    """A term that stands only with one address is found; common words and texts without it are left alone."""
    texts = [f"{prose(i, 30)} contact jo@mail.com about projectx{i % 2}7 soon {prose(100 + i, 10)}" for i in range(8)]
    texts += [prose(200 + i, 60) + " contact soon about" for i in range(60)] + [texts[0]] * 3 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r["term"]: r["action"] for r in privacy.disclosing_terms(docs).collect()}
    assert {"projectx07", "projectx17"} <= set(terms) and not set(terms) & {"contact", "soon", "about", "the", "river"}
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(docs).collect()}
    assert "[EMAIL]" in clean[0] and "projectx07" not in clean[0] and "mail.com" not in clean[0]
    assert all(clean[i] == texts[i] for i in range(8, 68)) and clean[71] == ""
    words = [set(re.findall(r"\w+", (t or "").replace("jo@mail.com", " ").lower())) for t in texts]
    holds = ["jo@mail.com" in (t or "") for t in texts]
    for w in set().union(*words):
        both, alone = sum(w in s and h for s, h in zip(words, holds, strict=True)), sum(w in s for s in words)
        different = len({t for t, s, h in zip(texts, words, holds, strict=True) if h and w in s})
        full = different >= 3 and np.log(len(texts) * both / (sum(holds) * alone)) >= np.log(len(texts) / sum(holds)) - 1e-9
        assert (w in terms) == full, w


def test_strays_do_not_end_the_detection(spark):
    """A name with one address is found although it stands once without it; that other text is left alone."""
    texts = [f"{prose(i, 30)} ask jo@mail.com or zebulon at {prose(300 + i, 10)}" for i in range(20)]
    texts += [f"{prose(100 + i, 60)} ask or at" for i in range(200)] + [f"{prose(400, 40)} zebulon ask", f"{prose(401, 40)} zebulon x@y.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["term"] for r in privacy.disclosing_terms(docs).collect()} == {"zebulon"}
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(docs).collect()}
    assert not any("zebulon" in clean[i] for i in range(20))
    assert all(clean[i] == texts[i] for i in range(20, 221)) and clean[221] == texts[221].replace("x@y.org", "[EMAIL]")


def test_query_of_personal_data_equals_its_sql(spark, tmp_path):
    """The driver's documents, odd texts, and names that give an address away."""
    compare(privacy.op5_pii(spark, SF_SMALL), privacy.ORACLE_SQL)
    texts = TRICKY + [f"{prose(i, 30)} ask jo@mail.com or Zebulon{i % 2}9 at {prose(300 + i, 10)}" for i in range(20)] + [f"{prose(100 + i, 60)} ask or at" for i in range(100)]
    texts += [texts[-1], texts[20], f"{prose(400, 40)} zebulon19 ask"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = privacy.op5_pii(spark, str(tmp_path))
    compare(found, privacy.ORACLE_SQL, {"documents": f"{tmp_path}/documents.parquet/*.parquet"})
    assert found.where("spans like '%term%'").count() >= 20


def test_lists_of_addresses_stay_linear(spark, monkeypatch):
    """One text with 2,000 addresses, and one list of 300 that five texts repeat: no row for every pair of address and word."""
    sizes = {}
    real = privacy.stored

    def watched(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(privacy, "stored", watched)
    alone = " ".join(f"a{i}@x{i}.org w{i}" for i in range(2000))
    repeated = " ".join(f"b{i}@y.org v{i}" for i in range(300))
    texts = [alone, *(f"{repeated} {prose(i, 5)}" for i in range(5)), *(prose(50 + i, 40) for i in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r["term"] for r in privacy.disclosing_terms(docs).collect()}
    assert {f"v{i}" for i in range(300)} <= terms and "w7" not in terms
    assert sizes["protected"] == 1 and sizes["guarded"] == 5 and max(sizes.values()) < 10_000


def test_privacy_edges(edge_docs, make):
    rows = privacy.find(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert privacy.find(make([])).count() == 0 and privacy.sanitised(make([])).count() == 0


# quality

def test_quality_held_out(spark):
    got = quality.op6_quality_classifier(spark, SF)
    rows = got.join(quality.graded(spark.read.parquet(f"{SF}/labels.parquet")), "doc_id").where("held_out").collect()
    assert got.count() == 1000
    assert np.mean([r["keep"] for r in rows if r["grade"] == 2]) > 0.95
    assert np.mean([r["keep"] for r in rows if r["grade"] < 2]) < 0.35
    assert np.mean([r["expected_grade"] for r in rows if r["grade"] == 2]) > np.mean([r["expected_grade"] for r in rows if r["grade"] < 2]) + 0.5


def test_cumulative_link_model_recovers_grades():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(1500):
        x = np.unique(rng.integers(0, 40, 6))
        z = 2.5 * (x < 8).sum() - 2.5 * ((x >= 8) & (x < 16)).sum() + rng.logistic()
        rows.append(x.astype(np.int32))
        grades.append(int(z > -2) + int(z > 2))
    model = quality.fit(np.array(grades), rows)
    assert (np.diff(model.thresholds) > 0).all()
    p = np.array([model.score(r) for r in rows])
    assert (p[:, 0] >= p[:, 1]).all()
    assert np.mean(np.abs(p.sum(axis=1) - grades)) < 0.45


def test_quality_edges(edge_docs, make, spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, None), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    grades = quality.graded(labels)
    assert sorted(map(tuple, grades.collect())) == [(0, 1), (5, 2)]
    for some in (grades, grades.where("grade = 2"), grades.where("grade > 5")):
        model = quality.fit(*quality.fit_rows(edge_docs, some))
        assert edge_docs.select(quality.graded_text(edge_docs["text"], model).alias("g")).where("g.expected is null").count() == 0
        assert make([]).select(quality.graded_text(F.col("text"), model)).count() == 0


# decontamination

def lcs_plain(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def test_lcs_matches_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(0, 25))] for _ in range(2))
        assert decontamination.lcs(a, b) == lcs_plain(a, b)


def test_latent_space_matches_a_full_svd(spark):
    items = spark.createDataFrame([(i, prose(i, 40)) for i in range(12)] + [(None, "x"), (90, None), (91, "..")], "item_id long, text string")
    idf = np.ones(decontamination.TERMS, np.float32)
    rows = decontamination.passages(items, idf)
    dense = np.zeros((12, decontamination.TERMS))
    for i, r in enumerate(rows.collect()):
        dense[i, r["terms"]] = r["values"]
    space = decontamination.latent_space(rows, dimensions=8)
    full = np.linalg.svd(dense, full_matrices=False)[2][:8]
    assert np.allclose(space.T @ space, np.eye(8), atol=1e-3)
    assert np.linalg.norm(dense @ space) > 0.999 * np.linalg.norm(dense @ full.T)


def test_spaces_keep_a_share_of_every_passage(spark):
    """Fewer dimensions than passages; every passage keeps KEPT of its norm, and one dimension less would not do."""
    items = spark.createDataFrame([(i, prose(i, 150)) for i in range(40)], "item_id long, text string")
    rows = decontamination.passages(items, np.ones(decontamination.TERMS, np.float32)).cache()
    for row in decontamination.fitted(rows, 3).collect():
        n, kept = len(row["items"]), np.frombuffer(row["kept"], "<f4")
        assert row["dimensions"] < n and kept.min() >= decontamination.KEPT - 1e-5
        basis = np.frombuffer(row["basis"], "<f4").reshape(-1, row["dimensions"])
        assert np.allclose(basis.T @ basis, np.eye(row["dimensions"]), atol=1e-3)
        live = {t: i for i, t in enumerate(np.frombuffer(row["terms"], "<i4").tolist())}
        held = {(r["item_id"], r["at"]): r for r in rows.collect()}
        for item, at, share in zip(row["items"], row["at"], kept, strict=True):
            r = held[item, at]
            latent = np.asarray(r["values"]) @ basis[[live[t] for t in r["terms"]]]
            assert abs(np.linalg.norm(latent) - share) < 1e-3
            assert row["dimensions"] == 1 or share >= np.linalg.norm(latent[:-1]) - 1e-6


def test_paraphrase_without_the_rare_words(spark):
    """Rare words are replaced by others that the benchmark has beside them: no rare word is shared, so TF-IDF misses it; the latent space does not."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    rare, other = [f"rare{i}" for i in range(12)], [f"other{i}" for i in range(12)]
    item = " ".join(w for i in range(12) for w in (common[i], common[(i + 5) % 12], rare[i])[: 3 if i % 2 else 2]) + " " + " ".join(rare[::2])
    told = item.replace("rare", "other")
    both = [(10 + k, " ".join(f"{rare[i]} {other[i]}" for i in rng.sample(range(12), 12))) for k in range(12)]
    docs = [(0, told)] + [(1 + i, " ".join(rng.sample(common, 12) + [f"own{i}x{j}" for j in range(20)])) for i in range(200)]
    found = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), *both], "item_id long, text string"))
    assert [tuple(r) for r in found.where("leaked").select("doc_id", "item_id").collect()] == [(0, 1)]
    n, frequency = decontamination.document_frequency(spark.createDataFrame(docs, "doc_id long, text string"))
    idf = decontamination.weights(n, frequency)
    bag = lambda text: np.bincount(decontamination.Splitter().words([text.encode()], 0).terms, minlength=decontamination.TERMS) * idf
    a, b = bag(item), bag(told)
    assert a @ b / np.sqrt((a @ a) * (b @ b)) < 0.1 * decontamination.MIN_COSINE


def test_hundreds_of_items_in_blocks(spark, monkeypatch):
    """Several spaces and blocks: every quoted item is found, and nothing else."""
    monkeypatch.setattr(decontamination, "SPACE", 64)
    monkeypatch.setattr(decontamination, "BLOCK", 512)
    say = spoken(random.Random(14))
    items = [(i, f"{say(35)}. {say(35)}.") for i in range(400)]
    texts = [(i, f"{say(30)} {items[i][1] if i % 3 == 0 else ''} {say(30)}") for i in range(400)]
    found = decontamination.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.where("leaked").collect()} == {(i, i) for i in range(0, 400, 3)}


def test_item_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([(0, f"{prose(1, 20)} {prose(31, 30)}"), (1, prose(2, 60))], "doc_id long, text string")
    items = spark.createDataFrame([("suite-7", prose(31, 30)), ("12", prose(32, 30))], "item_id string, text string")
    assert [(r["leaked"], r["item_id"]) for r in decontamination.matches(docs, items).orderBy("doc_id").collect()] == [(True, None), (False, None)]


def test_leaks_and_paraphrases(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "brtkmls" for b in ("an", "or", "il", "et") for c in ("do", "my", "ka", "sen", "th")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(20)}. {say(8)}.") for i in range(30)]
    texts, leaks = [], {}
    for i in range(200):
        words = say(rng.choice([5, 60, 400])).split()
        if i % 4 == 0:
            item = rng.choice(items)
            told = item[1].upper().split()
            if i % 8 == 0:  # some words of the question change, the answer stays
                for k in rng.sample(range(20), 6):
                    told[k] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = told
            leaks[i] = item[0]
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame([*texts, (1000, None), (1001, ""), (1002, "?!")], "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (None, "x y"), (500, None), (501, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.matches(docs, benchmark).collect()}
    assert len(got) == 203
    assert {d: r["item_id"] for d, r in got.items() if r["leaked"]} == leaks


def test_every_copy_of_a_large_benchmark(spark):
    """Each of 1,000 items is found where it is planted word for word, also when it is rare in latent directions."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "brtkmlsdpg" for b in ("an", "or", "il", "et", "us", "em") for c in ("do", "my", "ka", "sen", "th", "ri", "ba", "po", "ne", "lu")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(16, 60))) for i in range(1000)]
    docs = spark.createDataFrame([(i, f"{say(30)} {t} {say(30)}") for i, t in items] + [(2000 + i, say(100)) for i in range(200)], "doc_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).where("leaked").collect()}
    assert got == {i: i for i in range(1000)}


def spoken(rng):
    vocabulary = [f"{a}{b}{c}" for a in "brtkmls" for b in ("an", "or", "il", "et") for c in ("do", "my", "ka", "sen", "th")]
    return lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))


def test_quoted_passages_and_items_of_one_sentence(spark):
    """48 words from anywhere in an item of 200 words are a leak, and 70 % of the words of a one-sentence item."""
    rng = random.Random(12)
    say = spoken(rng)
    items = [(i, f"{say(100)}. {say(100)}.") for i in range(6)] + [(10 + i, say(30)) for i in range(6)]
    texts, leaks = [(500 + i, say(150)) for i in range(100)], {}
    for i, (item, text) in enumerate(items):
        words = text.split()
        for k in range(4):
            told = words[at:at + 48] if len(words) > 48 and (at := rng.randrange(len(words) - 47)) >= 0 else words[:]
            if len(words) < 48:
                for j in rng.sample(range(30), 9):
                    told[j] = say(1)
            texts.append((4 * i + k, f"{say(40)} {' '.join(told)} {say(40)}"))
            leaks[4 * i + k] = item
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).where("leaked")
    assert {r["doc_id"]: r["item_id"] for r in got.collect()} == leaks


def test_short_frequent_items_among_rare_words(spark):
    """An item of 15 words in a third of the rows, and one in all rows, are found although the words around them are rare."""
    say = spoken(random.Random(13))
    items = [(0, say(15)), (1, " ".join(f"w{i}" for i in range(15)))]
    rare = lambda i, k: " ".join(f"rare{i}x{j}" for j in range(k))
    texts = [(i, f"{rare(i, 5 + i % 24)} {items[0][1] if i % 3 == 0 else ''} {rare(i + 1000, 30)}") for i in range(300)]
    found = lambda rows, item: {r["doc_id"] for r in decontamination.matches(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([item], "item_id long, text string")).where("leaked").collect()}
    assert found(texts, items[0]) == set(range(0, 300, 3))
    assert found([(i, f"{rare(i, 5 + i % 24)} {items[1][1]} {rare(i + 1000, 30)}") for i in range(48)], items[1]) == set(range(48))


def test_leaks_match_brute_force(spark):
    """Every document against every item by plain dynamic programming over windows of words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = {r["item_id"]: " ".join(decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {r["doc_id"] for r in docs if any(t in " ".join(decontamination.words_of(r["text"])) for t in items.values())}
    got = {r["doc_id"] for r in decontamination.op7_benchmark_decontamination(spark, SF).where("leaked").collect()}
    assert got == whole


def test_decontamination_edges(edge_docs, make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.matches(edge_docs, none).where("leaked").count() == 0
    items = spark.createDataFrame([(1, prose(3, 5)), (1, prose(2, 80)), (2, prose(2, 80))], "item_id long, text string")
    kept = decontamination.clean_only(edge_docs, items)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 7})
    assert decontamination.clean_only(make([]), items).count() == 0 and decontamination.matches(make([]), items).count() == 0


def test_items_that_share_an_id_or_have_none(spark):
    """All their texts are searched."""
    shared = [(1, prose(21, 30)), (1, prose(22, 30)), (None, prose(23, 30)), (1, prose(22, 30))]
    docs = spark.createDataFrame([(i, f"{prose(40 + i, 40)} {t}") for i, (_, t) in enumerate(shared[:3])] + [(3, prose(50, 60))], "doc_id long, text string")
    benchmark = spark.createDataFrame(shared, "item_id long, text string")
    assert [(r["leaked"], r["item_id"]) for r in decontamination.matches(docs, benchmark).orderBy("doc_id").collect()] == [(True, 1), (True, 1), (True, None), (False, None)]
    assert [r["doc_id"] for r in decontamination.clean_only(docs, benchmark).collect()] == [3]


# packing

def check_packing(rows, capacity=1024):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit_decreasing(lengths, capacity=1024):
    room, bins = np.zeros(capacity + 1, int), 0
    for n in sorted(lengths, reverse=True):
        fits = np.flatnonzero(room[n:])
        if len(fits):
            room[n + fits[0]] -= 1
            room[fits[0]] += 1
        else:
            bins += 1
            room[capacity - n] += 1
    return bins


def test_pieces_and_packing_match_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    rows = packing.op3_best_fit_packing(spark, SF).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    expected = {}
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[(doc, piece)] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert got == expected
    assert check_packing(rows) <= 1.01 * best_fit_decreasing([r["length"] for r in rows]) + 1


@pytest.mark.parametrize("case", range(5))
def test_plan_places_every_rank_once(case):
    rng = np.random.default_rng(case)
    lengths = [
        rng.integers(1, 1025, 3000), np.full(500, 341), rng.integers(1, 40, 2000), np.r_[np.full(700, 512), np.full(701, 513), [1024] * 5], np.array([], int),
    ][case]
    sizes, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan(sizes.tolist(), counts.tolist())
    rows = [{"length": n, "sequence_id": s + r, "offset": o} for n, a, b, s, o in plan for r in range(b - a)]
    ranks = sorted((n, r) for n, a, b, _, _ in plan for r in range(a, b))
    assert ranks == [(int(n), r) for n, c in zip(sizes, counts, strict=True) for r in range(c)]
    assert check_packing(rows) <= 1.01 * best_fit_decreasing(lengths.tolist()) + 1


def test_encoding_in_pieces(monkeypatch):
    text = prose(1, 4000) + "\n\n  12  été's   " + "x" * 3000 + " <|endoftext|> " + prose(2, 500)
    encode = packing.encoder(packing.vocabulary_path())
    whole = encode(text)
    monkeypatch.setattr(packing, "PIECE", 100)
    assert np.array_equal(whole, encode(text))


def test_added_tokens_have_their_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["a <|endoftext|> b", end, end * 3, f"  {end}  \n{end}x", f"<|endoftext{end}|>", f"{prose(1, 300)}{end} {prose(2, 300)} \n {end}", "<|endoftext", ""]
    encode = packing.encoder(packing.vocabulary_path())
    for piece in (packing.PIECE, 100):
        monkeypatch.setattr(packing, "PIECE", piece)
        assert [encode(t).tolist() for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_sequences_round_trip(spark):
    docs = spark.createDataFrame([(i, prose(i, n)) for i, n in enumerate([5, 900, 3000, 1, 0, 200, 700])] + [(9, None)], "doc_id long, text string")
    packed = packing.pack(packing.tokenized(docs)).cache()
    ids = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.sequences(packed).collect()}
    encode = packing.encoder(packing.vocabulary_path())
    for doc, text in docs.collect():
        pieces = sorted((r["piece"], r["sequence_id"], r["offset"], r["length"]) for r in packed.where(F.col("doc_id") == doc).collect())
        joined = np.concatenate([ids[s][o:o + n] for _, s, o, n in pieces])
        assert joined.tolist() == [*encode(text or "").tolist(), 2]


def test_packing_edges(edge_docs, make):
    rows = packing.packed_documents(edge_docs).collect()
    check_packing(rows)
    assert len({(r["doc_id"]) for r in rows}) == edge_docs.select("doc_id").distinct().count()
    assert sum(r["piece"] == 0 for r in rows) == edge_docs.count()
    assert packing.packed_documents(make([])).count() == 0


# chat formatting

def test_escaping_round_trip():
    rng = random.Random(4)
    bits = [*chat_format.CONTROL, "\\", "\\\\", "<", "[", "|", "a", "\n", "é", "<|image:0|>"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 8)))
        hidden = chat_format.escaped(text)
        assert chat_format.unescaped(hidden) == text
        assert not any(c in hidden for c in chat_format.CONTROL)


def test_typed_parts():
    parts = [
        {"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "a.png", "width": 700, "height": 300}, None, {"type": "audio", "ref": "b.wav", "seconds": 2.5},
        {"type": "text", "text": "</s>"}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "video"}, {"type": "image"},
    ]
    made = chat_format.segment_of("assistant", parts)
    assert [(a["type"], a["ref"], a["tokens"]) for a in made["attachments"]] == [("image", "a.png", 3 * 144), ("audio", "b.wav", 63), ("document", "c.pdf", 3 * 512), ("image", None, 144)]
    for a in made["attachments"]:
        assert made["segment"].startswith(f"<|{a['type']}:{a['number']}|>", a["at"])
    assert chat_format.parts_of(made["segment"]) == [("text", "see <|image:0|> "), ("image", "0"), ("audio", "1"), ("text", "</s>"), ("document", "2"), ("image", "3")]
    assert "video" in made["problems"] and made["expanded_tokens"] == 3 * 144 + 63 + 3 * 512 + 144


def test_conversations_read_back(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").toPandas()
    got = {r["conv_id"]: r for r in chat_format.op8_chat_format(spark, SF_SMALL).collect()}
    said = "</s>[INST] ok [/INST]"
    conversations = {c: list(zip(g["role"], g["text"], strict=True)) for c, g in rows.sort_values("turn").groupby("conv_id")}
    conversations[-7] = [("user", said), ("assistant", said)]
    assert set(got) == set(conversations)
    for conv, turns in conversations.items():
        every = "".join(f"{r}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_query_of_chat_equals_its_sql(spark, tmp_path):
    compare(chat_format.op8_chat_format(spark, SF_SMALL), chat_format.ORACLE_SQL)
    rng = random.Random(2)
    bits = [*chat_format.CONTROL, "\\", "a", "é", "\n", "<"]
    rows = [(c, t, rng.choice(["user", "assistant", None, "<s>"]), "".join(rng.choice(bits) for _ in range(6)) if rng.random() < 0.9 else None) for c in range(40) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    compare(chat_format.op8_chat_format(spark, str(tmp_path)), chat_format.ORACLE_SQL, {"conversations": f"{tmp_path}/conversations.parquet/*.parquet"})


def test_audio_without_a_finite_length():
    made = chat_format.segment_of("user", [{"type": "audio", "ref": "x", "seconds": s} for s in (float("nan"), float("inf"), -3.0, None)])
    assert made["expanded_tokens"] == 0 and made["problems"].count("audio") == 2 and len(made["attachments"]) == 4


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, segment string"
    rows = [(None, None, None, None, "x"), (None, 1, "user", "a", None), (1, 0, "user", "b", None), (1, 0, "user", "b", None), (1, None, "assistant", "y" * 300_000, None)]
    found = chat_format.formatted(spark.createDataFrame(rows, schema))
    got = {r["conv_id"]: r for r in chat_format.summaries(found).collect()}
    assert got[None]["n_turns"] == 2 and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 300_000
    assert chat_format.summaries(chat_format.formatted(spark.createDataFrame([], schema))).count() == 0
    typed = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, array(named_struct('type', 'image', 'text', cast(null as string), 'ref', 'r', 'width', 10, 'height', 10, 'seconds', cast(null as double), 'pages', cast(null as int))) parts")
    assert chat_format.formatted(typed).first()["attachments"][0]["ref"] == "r"
