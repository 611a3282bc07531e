"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents.
2. The benchmark's passages become TF-IDF rows, dealt into spaces of about SPACE. One job
   fits all spaces, a randomised SVD each, and keeps as few dimensions as leave every passage
   KEPT of its norm: words that passages have together share a direction, so that a window
   may be near a passage of whose rare words it has none.
3. Every window of every whole document is folded into the latent spaces; windows whose
   cosine with a benchmark passage reaches `MIN_COSINE`, times the share of its norm which that
   passage has kept, are candidates (the window's length in the cosine is that of its full
   TF-IDF vector, so that words which no passage has count against it; but rare words
   around a short or frequent passage do not: no more than the passage's own length counts
   for the threshold). A word-for-word copy stays above it: projections of the windows that
   hold 48 words add up to the passage's, so one of three has a third of it.
4. A candidate is confirmed by the longest common subsequence of words between the
   passage, and also its whole item, and the text around the window: it is a leak if it
   has `VERBATIM` of the words of either in order, or, as a paraphrase, `PARAPHRASE` of
   them and `ANSWER` of the item's answer (its last sentence) too. Items of one sentence
   have no answer apart: `PARAPHRASE` of their words is enough. Passages overlap so that
   a quotation of PASSAGE words from anywhere in an item has VERBATIM of some passage.

Documents are read where they are: only counts, and the digests of leaked texts with
their verdicts, leave a task. The benchmark is the stated query set; it is searched in
blocks of BLOCK passages, one pass each, so that what the driver and a task hold
is a block, whatever its size: fitted spaces are rows of a table until then.

Defined results: null, empty and wordless texts are clean; benchmark items with a null or
wordless text match nothing; with no items every document is clean, and an empty table
gives an empty result. Every different text of the benchmark is searched, also those that
share an item_id or have none. Of several matching items the one with the largest LCS
share counts, of equal ones the smallest item_id, a null one last. Repeated rows get equal verdicts. Other columns may
have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillstone.llm.common import by_value, free_name, read, small_batches, stored

#: Hashed words: the size of the term space, and so of all that is summed over it.
TERMS = 1 << 16
OVERSAMPLE = 10
POWER_STEPS = 1
#: The least share of its norm that a passage keeps in its latent space.
KEPT = 0.7
#: Benchmark passages of one latent space (about: dealt by hash), and of all those that one search holds; neighbours of an item that stay together.
SPACE, BLOCK, TOGETHER = 256, 1024, 16
#: Words of a window and of the step between windows; benchmark passages are cut to PASSAGE words, one every STRIDE words.
WINDOW, STEP, PASSAGE, STRIDE = 24, 12, 48, 16
MIN_COSINE = 0.3
#: Least weight of a word, also of one that every document has.
LEAST_WEIGHT = 0.01
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Bytes of texts that are split into words at once.
GROUP = 1 << 19

#: Punctuation beyond ASCII that separates words; ASCII separates by IS_WORD.
MARKS = re.compile("[\u00a1\u00ab\u00b7\u00bb\u00bf\u2010-\u2027\u2030-\u205e]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Bytes of words: lower-case letters, digits, and all of UTF-8's beyond ASCII.
IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
BASE = 0x9E3779B97F4A7C15


def lowered(text: str | None) -> bytes:
    lower = (text or "").lower()
    return (lower if lower.isascii() else MARKS.sub(" ", lower)).encode("utf-8", "surrogatepass")


class Splitter:
    """Words of texts as places in a buffer and 64-bit hashes, many at once.

    A word's hash is a polynomial in its bytes: a difference of prefix sums, brought
    to the word's beginning by the inverse power.
    """

    def __init__(self) -> None:
        self.power = np.cumprod(np.r_[1, np.full(2 * GROUP, BASE, np.uint64)].astype(np.uint64))
        self.inverse = np.cumprod(np.r_[1, np.full(2 * GROUP, pow(BASE, -1, 1 << 64), np.uint64)].astype(np.uint64))

    def split(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last place and hash of the words of at most 2 GROUP bytes."""
        data = np.frombuffer(buffer, np.uint8)
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = IS_WORD[data]
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.power[:len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return starts, ends, h ^ (h >> np.uint64(32))

    def groups(self, texts: list[str | None]) -> Iterator[Words]:
        """The words of all texts, in groups of whole texts."""
        held: list[bytes] = []
        size = at = 0
        for i, text in enumerate(texts):
            data = lowered(text)
            if held and size + len(data) > GROUP:
                yield self.words(held, at)
                held, size, at = [], 0, i
            held.append(data)
            size += len(data) + 1
        if held:
            yield self.words(held, at)

    def words(self, held: list[bytes], at: int) -> Words:
        buffer = b"\n".join(held)
        found, begin = [], 0
        while begin < len(buffer) or not found:
            end = begin + GROUP  # a long text is cut between words, a word of GROUP bytes anywhere
            while end < min(len(buffer), begin + 2 * GROUP) and IS_WORD[buffer[end]]:
                end += 1
            starts, ends, hashes = self.split(buffer[begin:end])
            found.append((starts + begin, ends + begin, hashes))
            begin = end
        starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        texts = np.cumsum([0, *(len(h) + 1 for h in held)])
        return Words(at, buffer, starts, ends, hashes, np.searchsorted(starts, texts))


class Words:
    """The words of some texts: text i (from `at`) has the words first[i] to first[i + 1]."""

    def __init__(self, at: int, buffer: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray):
        self.at, self.buffer, self.starts, self.ends, self.hashes, self.first = at, buffer, starts, ends, hashes, first
        self.terms = (hashes >> np.uint64(48)).astype(np.int32)
        self.owner = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def read(self, a: int, b: int) -> list[str]:
        return [self.buffer[x:y].decode("utf-8", "replace") for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return [w.decode("utf-8", "replace") for w in re.findall(rb"[0-9a-z\x80-\xff]+", lowered(text))]


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and how many have each term (at most TERMS numbers reach the driver)."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter, n, rows = Splitter(), np.zeros(TERMS, np.int64), 0
        for batch in batches:
            rows += len(batch)
            for words in splitter.groups(batch["text"].tolist()):
                n += np.bincount(np.unique(words.owner * TERMS + words.terms) % TERMS, minlength=TERMS)
        term = np.flatnonzero(n)
        yield pd.DataFrame({"term": np.append(term, -1), "n": np.append(n[term], rows)})

    got = docs.select(F.col("text").alias("text")).mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, rows = np.zeros(TERMS, np.int64), 0
    for r in got:
        if r["term"] < 0:
            rows = r["n"]
        else:
            out[r["term"]] = r["n"]
    return rows, out


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.maximum(np.log((1 + n_docs) / (1 + frequency)), LEAST_WEIGHT).astype(np.float32)


def starts_of(n: int) -> list[int]:
    """First words of the passages of an item of n words; the last one ends with the item."""
    return [*range(0, n - PASSAGE, STRIDE), max(0, n - PASSAGE)]


def passages(items: DataFrame, idf: np.ndarray) -> DataFrame:
    """item_id, at, norm, terms, values: first words, lengths and unit TF-IDF rows of the benchmark's passages."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                terms = splitter.words([lowered(text)], 0).terms
                for at in starts_of(len(terms)):
                    term, n = np.unique(terms[at:at + PASSAGE], return_counts=True)
                    value = n * idf[term]
                    norm = float(np.sqrt((value * value).sum()))
                    if norm > 0:
                        rows.append((item, at, norm, term.tolist(), (value / norm).tolist()))
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "at", "norm", "terms", "values"])

    known = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    return known.mapInPandas(cut, "item_id long, at int, norm double, terms array<int>, values array<float>")


SPACES = "space long, terms binary, basis binary, dimensions int, items array<long>, at array<int>, norms binary, kept binary, latent binary"


def right_vectors(rows: np.ndarray, power_steps: int = POWER_STEPS) -> np.ndarray:
    """Right singular vectors of a matrix, largest first, by a randomised range finder."""
    probe = np.random.default_rng(7).standard_normal((rows.shape[1], len(rows) + OVERSAMPLE)).astype(np.float32)
    found = rows @ probe
    for _ in range(power_steps):
        found, _ = np.linalg.qr(found)
        found = rows @ (rows.T @ found)
    range_of, _ = np.linalg.qr(found)
    inside = (range_of.T @ rows).astype(np.float64)
    value, vector = np.linalg.eigh(inside @ inside.T)
    order = np.argsort(-value)
    order = order[value[order] > max(value.max(), 0) * 1e-9]
    return inside.T @ (vector[:, order] / np.sqrt(value[order]))


def fitted(rows: DataFrame, n_spaces: int, kept: float = KEPT, most: int | None = None) -> DataFrame:
    """SPACES: the latent spaces of all passages, in one job, each of the least dimensions (`most` at most) that leave every passage `kept` of its norm."""

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item_id", "at"])
        live, place = np.unique(np.concatenate(group["terms"].tolist()), return_inverse=True)
        matrix = np.zeros((len(group), len(live)), np.float32)
        matrix[np.repeat(np.arange(len(group)), [len(t) for t in group["terms"]]), place] = np.concatenate(group["values"].tolist())
        basis = right_vectors(matrix)
        latent = matrix @ basis
        share = np.sqrt(np.cumsum(latent * latent, axis=1))  # a passage's row has length one
        enough = np.flatnonzero(share.min(axis=0) >= min(kept, share[:, -1].min()))
        dimensions = min(int(enough[0]) + 1, most or len(group))
        latent, share = latent[:, :dimensions], np.maximum(share[:, dimensions - 1], 1e-9)
        return pd.DataFrame({
            "space": [key[0]], "terms": [live.astype("<i4").tobytes()], "basis": [basis[:, :dimensions].astype("<f4").tobytes()], "dimensions": [dimensions],
            "items": [group["item_id"].tolist()], "at": [group["at"].tolist()], "norms": [group["norm"].to_numpy().astype("<f4").tobytes()],
            "kept": [share.astype("<f4").tobytes()], "latent": [(latent / share[:, None]).astype("<f4").tobytes()]})

    dealt = rows.withColumn("space", F.pmod(F.xxhash64("item_id", F.floor(F.col("at") / (STRIDE * TOGETHER))), F.lit(n_spaces)))
    return dealt.groupBy("space").applyInPandas(fit, SPACES)


def latent_space(rows: DataFrame, dimensions: int) -> np.ndarray:
    """Terms by latent dimensions: the first right singular vectors of the rows, as one space."""
    row = fitted(rows, 1, 1.0, dimensions).first()
    space = np.zeros((TERMS, row["dimensions"]), np.float32)
    space[np.frombuffer(row["terms"], "<i4")] = np.frombuffer(row["basis"], "<f4").reshape(-1, row["dimensions"])
    return space


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of `a`."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[str]:
    """The words of an item's last sentence; none if it has only one."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    return parts[-1] if len(parts) > 1 else []


def confirmed(part: list[str], answer: list[str], near: list[str], around: list[str]) -> tuple[float, bool]:
    """The share of the words of an item, or of a passage, found in order `near` a window, and whether, with the answer `around` it, that is a leak."""
    share = lcs(part, near) / len(part)
    return share, share >= VERBATIM or share >= PARAPHRASE and lcs(answer, around) >= ANSWER * len(answer)


class Folding:
    """What folds windows into one latent space (a row of SPACES) and compares them with its passages."""

    def __init__(self, row, idf: np.ndarray):
        live = np.frombuffer(row["terms"], "<i4")
        self.used = np.zeros(TERMS, np.int32)
        self.used[live] = np.arange(1, len(live) + 1)
        basis = np.frombuffer(row["basis"], "<f4").reshape(len(live), row["dimensions"])
        self.table = np.vstack([np.zeros((1, row["dimensions"]), np.float32), basis * idf[live, None]]).astype(np.float32)
        self.owners = list(zip(row["items"], row["at"], strict=True))
        self.norms, self.kept = np.frombuffer(row["norms"], "<f4"), np.frombuffer(row["kept"], "<f4")
        self.latent = np.frombuffer(row["latent"], "<f4").reshape(len(self.owners), row["dimensions"])


def search(text: Column, block: list[tuple[int, int | None, str]], foldings: list[Folding], idf: np.ndarray) -> Column:
    """struct<item_id, cosine, lcs> of the best confirmed leak in a text; null fields if it is clean.

    `block` has the key, item_id and text of the items; the foldings name items by their keys.
    """
    owners = [o for f in foldings for o in f.owners]
    square = (idf * idf).astype(np.float64)

    def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, passage and cosine of the candidate windows."""
        blocks = -(-np.diff(words.first) // STEP)
        owner = np.repeat(np.arange(len(blocks)), blocks)
        steps = words.first[owner] + STEP * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        ends = words.first[owner + 1]
        norms = np.add.reduceat(square[words.terms], steps)
        # a window is two blocks of one text; a text's last block, with nothing after it, is in the window before
        pair = owner[1:] == owner[:-1]
        lone = np.r_[True, ~pair] & np.r_[~pair, True]
        first = np.flatnonzero(np.r_[pair, False] | lone)
        second = np.where(lone[first], first, first + 1)
        norm = np.sqrt(np.maximum(norms[first] + np.where(lone[first], 0, norms[second]), 1e-9)).astype(np.float32)
        found, at = [], 0
        for f in foldings:
            place = np.append(f.used[words.terms], 0)
            parts = f.table[place[steps]]
            for j in range(1, STEP):
                parts += f.table[place[np.where(steps + j < ends, steps + j, -1)]]  # beyond the text: the zero row
            both = parts[first] + np.where(lone[first, None], 0, parts[second])
            # a product is at most the part of the window that lies in the latent space
            able = np.flatnonzero(np.sqrt((both * both).sum(axis=1)) >= MIN_COSINE * f.kept.min() * np.minimum(norm, f.norms.min()))
            product = both[able] @ f.latent.T
            row, passage = np.nonzero(product >= MIN_COSINE * f.kept * np.minimum(norm[able, None], f.norms))
            found.append((owner[first[able[row]]], steps[first[able[row]]], at + passage, product[row, passage] / norm[able[row]]))
            at += len(f.owners)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def order(item_id: int | None, cosine: float, share: float) -> tuple:
        return -share, item_id is None, item_id or 0, -cosine

    @pandas_udf("item_id long, cosine double, lcs double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        splitter = Splitter()
        items = {key: (words_of(t), answer_of(t), splitter.words([lowered(t)], 0).hashes.tolist()) for key, _, t in block}
        ids = {key: i for key, i, _ in block}
        for batch in batches:
            best: list[tuple] = [(None, None, None)] * len(batch)
            for words in splitter.groups(batch.tolist()):
                if not len(words.starts):
                    continue
                done: set[tuple[int, int, int]] = set()
                text, start, passage, cosine = windows(words)
                for k in np.argsort(-cosine, kind="stable").tolist():
                    t, s, (key, at) = int(text[k]), int(start[k]), owners[passage[k]]
                    item, answer, hashes = items[key]
                    spot = (t, int(passage[k]), s // max(min(len(item), PASSAGE), WINDOW))
                    if spot in done:
                        continue
                    share, leak = 0.0, False
                    for x, y in {(at, min(at + PASSAGE, len(item))), (0, len(item))}:  # the passage, and its item
                        a = max(int(words.first[t]), s - (y - x))
                        b = min(int(words.first[t + 1]), s + WINDOW + (y - x))
                        have = set(words.hashes[a:b].tolist())  # too few words in any order: no leak
                        if sum(map(have.__contains__, hashes[x:y])) < PARAPHRASE * (y - x):
                            continue
                        around = words.read(max(int(words.first[t]), s - len(item)), min(int(words.first[t + 1]), s + WINDOW + len(item)))
                        of_part, is_leak = confirmed(item[x:y], answer, words.read(a, b), around)
                        if is_leak:
                            share, leak = max(share, of_part), True
                    if leak:
                        done.add(spot)
                        old = best[words.at + t]
                        new = (ids[key], float(cosine[k]), share)
                        if old[2] is None or order(*new) < order(*old):
                            best[words.at + t] = new
            out = pd.DataFrame(best, columns=["item_id", "cosine", "lcs"])
            yield out.astype({"item_id": "Int64", "cosine": "float64", "lcs": "float64"})

    return of(text)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """digest (SHA-256) of each leaked text, and the item_id, cosine and lcs of its best match."""
    spark = docs.sparkSession
    n_docs, frequency = document_frequency(docs)
    idf = weights(n_docs, frequency)
    # an item_id may be repeated or null: a row's key is its own
    texts = items.where("text is not null").select(F.col("item_id").try_cast("long").alias("item_id"), "text").distinct()
    texts = stored(texts.select(F.monotonically_increasing_id().alias("key"), "item_id", "text"), "items")
    rows = stored(passages(texts.select(F.col("key").alias("item_id"), "text"), idf), "passages")
    spaces = stored(fitted(rows, max(1, -(-rows.count() // SPACE))), "spaces")
    sizes = [(r["space"], r["n"]) for r in spaces.select("space", F.size("items").alias("n")).orderBy("space").toLocalIterator()]
    schema = "digest string, item_id long, cosine double, lcs double"
    found = [spark.createDataFrame([], schema)]
    while sizes:
        block = [sizes.pop(0)]
        while sizes and sum(n for _, n in block) + sizes[0][1] <= BLOCK:
            block.append(sizes.pop(0))
        held = spaces.where(F.col("space").isin([k for k, _ in block]))
        wanted = held.select(F.explode("items").alias("key")).distinct()
        said = [tuple(r) for r in texts.join(wanted, "key", "left_semi").select("key", "item_id", "text").orderBy("key").collect()]
        foldings = [Folding(r, idf) for r in held.orderBy("space").collect()]
        hit = docs.select(docs["text"].alias("text"), search(docs["text"], said, foldings, idf).alias("m")).where("m.lcs is not null")
        found.append(stored(hit.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("m").alias("m")).select("digest", "m.*"), "leaks"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = F.struct((-F.col("lcs")).alias("l"), F.col("item_id").isNull().alias("n"), F.col("item_id").alias("i"), (-F.col("cosine")).alias("c"))
    best = every.groupBy("digest").agg(F.min(order).alias("b"))
    return best.select("digest", F.col("b.i").alias("item_id"), (-F.col("b.c")).alias("cosine"), (-F.col("b.l")).alias("lcs"))


def clean_only(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, all columns as they are."""
    name = free_name(docs, "_digest")
    leaked = leaks(docs, items).select(F.col("digest").alias(name))
    return docs.join(leaked, F.sha2(docs["text"], 256) == leaked[name], "left_anti")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, leaked, item_id, cosine, lcs for every document."""
    found = docs.select("doc_id", F.sha2(docs["text"], 256).alias("digest")).join(leaks(docs, items), "digest", "left")
    return found.select("doc_id", F.col("lcs").isNotNull().alias("leaked"), "item_id", "cosine", "lcs")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


by_value(__name__)
