"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point, so that all
workers agree). An n-gram's vector binds its letters: the elementwise product of the
letters' vectors, each permuted (rolled) by its distance from the n-gram's end. A text's profile
bundles (sums) the vectors of all its n-grams, a language's prototype those of its
training texts. A document gets the language with the highest cosine between its
profile and the prototype; prototypes and profiles are centred on the mean of the
prototypes, which all languages share.

Texts are lower-cased; runs of non-letters are one space. Only n-gram counts are kept
while a text is read, in pieces, so a very long text needs no more memory.

Defined results: null text, empty text and text without a letter give `und` and score
0. Ties go to the alphabetically first language. With no labelled text every document
is `und`. Rows are independent, so repeated rows give equal rows and an empty table
an empty result. Columns beside the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillstone.llm.common import by_value, free_name, read, small_batches

DIMENSIONS = 1024
GRAM = 3
#: A text is kept from this score on (a cosine of -0.5): below, its profile points away from every learned language.
LEAST = 0.25
UNKNOWN = "und"
#: Characters of a text that are turned into n-grams at once.
PIECE = 1 << 18
#: n-grams of documents that are compared at once.
CHUNK = 1 << 17
#: Languages that training may give: bounds what is collected and broadcast.
MAX_LANGUAGES = 2000


def letter_vectors(symbols: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each code point, made from a 64-bit mixing of it: the same everywhere."""
    words = np.arange(1, dimensions // 64 + 1, dtype=np.uint64)
    x = symbols.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + words[None, :] * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(symbols), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


class Grams:
    """n-gram codes of texts: 21 bits a letter."""

    def __init__(self, gram: int = GRAM):
        self.gram = gram
        self.letter = np.zeros(0x110000, bool)
        known = np.array([chr(i).isalpha() for i in range(0x33480)])
        self.letter[:len(known)] = known

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(self.letter[points], points, 32)
        points = np.concatenate(([32], points, [32])).astype(np.int64)
        points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
        n = len(points) - self.gram + 1
        if n < 1 or len(points) < 3:
            return np.zeros(0, np.int64)
        code = np.zeros(n, np.int64)
        for i in range(self.gram):
            code = (code << 21) | points[i:i + n]
        return code

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a whole text and their counts."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(text) <= PIECE:
            return np.unique(self.codes(text), return_counts=True)
        codes, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end - 1].isalpha():  # pieces end at a word's end
                end += 1
            more, n = np.unique(self.codes(text[at:end]), return_counts=True)
            codes, where = np.unique(np.concatenate([codes, more]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
            at = end
        return codes, counts


def gram_vectors(codes: np.ndarray, gram: int, dimensions: int) -> np.ndarray:
    """The bound vectors of n-grams, one row each (int8)."""
    letters = [(codes >> (21 * (gram - 1 - i))) & 0x1FFFFF for i in range(gram)]
    symbols, where = np.unique(np.concatenate(letters), return_inverse=True)
    vectors = letter_vectors(symbols, dimensions)
    bound = np.ones((len(codes), dimensions), np.int8)
    for i in range(gram):
        bound *= np.roll(vectors, gram - 1 - i, axis=1)[where[i * len(codes):(i + 1) * len(codes)]]
    return bound


def profiles(counted: list[tuple[np.ndarray, np.ndarray]], gram: int, dimensions: int) -> np.ndarray:
    """The bundled profiles of texts, one row each."""
    all_codes = np.concatenate([c for c, _ in counted])
    codes, where = np.unique(all_codes, return_inverse=True)
    owner = np.repeat(np.arange(len(counted)), [len(c) for c, _ in counted])
    counts = np.zeros((len(counted), len(codes)), np.float32)
    counts[owner, where] = np.concatenate([n for _, n in counted])
    out = np.zeros((len(counted), dimensions), np.float32)
    for at in range(0, len(codes), 8192):
        out += counts[:, at:at + 8192] @ gram_vectors(codes[at:at + 8192], gram, dimensions).astype(np.float32)
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", gram: int = GRAM, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their prototypes, one row each, from all labelled rows of `docs`.

    Each task bundles its own rows into one vector a language; only those are
    shuffled and summed. The driver gets languages times dimensions numbers.
    """
    small_batches(docs.sparkSession)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, sums = Grams(gram), {}
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                counted = [grams.counted(t) for t in texts]
                codes, where = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
                if not len(codes):
                    continue
                counts = np.bincount(where, np.concatenate([n for _, n in counted])).astype(np.float32)
                total = sums.setdefault(name, np.zeros(dimensions))
                for at in range(0, len(codes), 8192):
                    total += counts[at:at + 8192] @ gram_vectors(codes[at:at + 8192], gram, dimensions).astype(np.float32)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    parts = labelled.mapInPandas(bundle, "lang string, vector array<double>")
    sums = (
        parts.select("lang", F.posexplode("vector").alias("i", "x"))
        .groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("lang", F.col("v.x").alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    )
    if len(sums) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [r["lang"] for r in sums], np.array([r["v"] for r in sums], dtype=np.float64).reshape(len(sums), dimensions)


def identify(text: Column, languages: list[str], prototypes: np.ndarray, gram: int = GRAM) -> Column:
    """struct<lang, score>: the language of the highest cosine, and that cosine brought to 0 to 1."""
    dimensions = prototypes.shape[1]
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    middle = unit.mean(axis=0) if len(languages) > 1 else np.zeros(dimensions)
    centred = unit - middle
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    middle = middle.astype(np.float32)

    @pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams(gram)
        for texts in batches:
            counted = [grams.counted(t) for t in texts]
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            todo = [i for i, (c, _) in enumerate(counted) if len(c)] if languages else []
            while todo:
                sizes = np.cumsum([len(counted[i][0]) for i in todo])
                n = max(1, int(np.searchsorted(sizes, CHUNK, "right")))
                now, todo = todo[:n], todo[n:]
                rows = profiles([counted[i] for i in now], gram, dimensions)
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                rows -= middle
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                cosine = rows @ centred.T
                best = cosine.argmax(axis=1)
                names[now] = np.array(languages, object)[best]
                scores[now] = (1 + cosine[np.arange(len(now)), best]) / 2
            yield pd.DataFrame({"lang": names, "score": scores})

    return of(text)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (a null id: that of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def predicted(docs: DataFrame) -> Column:
    """The prediction column for `docs`, learned from its labelled rows outside fold 1."""
    languages, prototypes = train(docs.where(fold(docs["doc_id"]) != 1))
    return identify(docs["text"], languages, prototypes)


def identified_only(docs: DataFrame, languages: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """The documents whose predicted language is among `languages` (default: all learned ones) with a score of `least` or more, all columns as they are.

    Null texts and texts without a letter (`und`) go. Without labels to learn from every text with a letter stays.
    """
    small_batches(docs.sparkSession)
    name = free_name(docs, "_language")
    learned, prototypes = train(docs.where(fold(docs["doc_id"]) != 1))
    kept = F.lit(True) if languages is None or not learned else F.col(f"{name}.lang").isin(list(languages))
    if not learned:  # nothing to learn from: a letter is all that can be asked for
        learned, prototypes, least = ["any"], np.zeros((1, prototypes.shape[1])), 0.0
    found = docs.withColumn(name, identify(docs["text"], learned, prototypes))
    return found.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least) & kept).drop(name)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    small_batches(spark)
    return docs.select("doc_id", (fold(docs["doc_id"]) == 1).alias("held_out"), predicted(docs).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


by_value(__name__)
