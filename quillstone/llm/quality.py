"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Grades are ordered from 0 to K. One weight vector over hashed text features is shared by
all thresholds: P(grade > k) = sigmoid(w.x - t_k), with t_0 < t_1 < ... < t_(K-1). The
expected grade is the sum of these probabilities over k; the tail probability, that of
reaching `good`, selects documents.

Features of a whole text, each there or not: its distinct words, and words for its shape
(shares of capitals, of punctuation and of digits, repeated neighbours, share of distinct words), hashed
into BUCKETS. The model is fitted on at most FIT_ROWS labelled rows of each grade (those with
the smallest hash of their id, of several documents with one id the greatest text); of their features, those are used that occur in MIN_ROWS rows and
whose mean grade is SCREEN standard errors from the mean of all.

Defined results: null and empty texts have no words and get the grade of their shape. A label row
without a grade is not used; a document with several labels has the lowest grade. With
no labels, or one grade only, every document has that grade's score (0 without
labels). Repeated rows get equal scores; an empty table gives an empty result. Other
columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillstone.llm.common import by_value, read, small_batches

BUCKETS = 1 << 20
FIT_ROWS = 4000
MIN_ROWS = 5
SCREEN = 4.0
RIDGE = 0.5
GRADES = (0, 1, 2)
GOOD = 2
KEEP = 0.3
REMEMBERED = 300_000

WORD = re.compile(r"\w+")


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def level(share: float) -> int:
    """0 for nothing, then a step for each halving of the distance to 1 and from 0."""
    return int(np.digitize(share, (0.0025, 0.01, 0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95)))


def shape(text: str, lower: str) -> list[str]:
    """Words for the shape of a text; '#' is no word character, so they are no word's."""
    if not text:
        return ["#empty"]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = ((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122)) | (points >= 192)
    n_letters = int(letters.sum())
    capitals = ((points >= 65) & (points <= 90)) | ((points >= 192) & (points <= 222))
    digits = (points >= 48) & (points <= 57)
    marks = (points > 32) & (points < 127) & ~letters & ~digits
    words = lower.split()
    n = max(len(words), 1)
    again = sum(map(str.__eq__, words, words[1:]))
    return [  # shares of short texts are drawn to 0: a few marks say little there
        f"#capitals:{level(int(capitals.sum()) / (n_letters + 40))}",
        f"#marks:{level(int(marks.sum()) / (len(points) + 100))}",
        f"#digits:{level(int(digits.sum()) / (len(points) + 100))}",
        f"#again:{level(again / (n + 10))}",
        f"#distinct:{level((n - len(set(words))) / (n + 10))}:{min(n.bit_length(), 12)}",
    ]


class Features(dict):
    """Word to bucket, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = b = bucket(word)
        return b

    def of(self, text: str | None) -> np.ndarray:
        text = text or ""
        lower = text.lower()
        words = set(WORD.findall(lower))
        words.update(shape(text, lower))
        return np.unique(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 of low quality, 2 good; the lowest of a document's labels."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_rows(docs: DataFrame, grades: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Grades and features of the sample: at most `rows` of each grade reach the driver."""
    small_batches(docs.sparkSession)
    hashed = grades.withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    first = [hashed.where(F.col("grade") == g).orderBy("h", "doc_id").limit(rows) for g in GRADES]  # top-k, not a sort of all
    sample = reduce(DataFrame.unionByName, first).select("doc_id", "grade")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            yield pd.DataFrame({"grade": batch["grade"], "features": [features.of(t).tobytes() for t in batch["text"]]})

    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "grade").agg(F.max("text").alias("text"))
    got = texts.select("grade", "text").mapInPandas(work, "grade int, features binary").collect()
    got = sorted((r["grade"], bytes(r["features"])) for r in got)
    return np.array([g for g, _ in got], np.int64), [np.frombuffer(f, np.int32) for _, f in got]


class Model:
    """Selected buckets, their weights, and the thresholds between grades."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, base: float):
        self.weight = dict(zip(buckets.tolist(), weights.tolist(), strict=True))
        self.thresholds, self.base = thresholds, base

    def score(self, features: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        z = sum(map(self.weight.get, filter(self.weight.__contains__, features.tolist())))
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -500, 500)))


def fit(grades: np.ndarray, rows: list[np.ndarray], ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge, by gradient steps with per-feature scaling (Adam)."""
    present = sorted(set(grades.tolist()))
    if len(present) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), float(present[0]) if present else 0.0)
    top = int(grades.max())
    sizes = np.array([len(r) for r in rows])
    owner, column = np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows)
    seen = np.bincount(column, minlength=BUCKETS)
    mean, deviation = grades.mean(), max(float(grades.std()), 1e-6)
    total = np.bincount(column, grades[owner], minlength=BUCKETS)
    z = (total / np.maximum(seen, 1) - mean) / (deviation / np.sqrt(np.maximum(seen, 1)))
    chosen = np.flatnonzero((seen >= MIN_ROWS) & (np.abs(z) >= SCREEN))
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    live = place[column] >= 0
    owner, column = owner[live], place[column[live]]

    w = np.zeros(len(chosen))
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    free = np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-2))]  # thresholds as a start and positive steps
    weight = (len(grades) / (len(present) * np.bincount(grades, minlength=top + 1).clip(1)))[grades]
    weight = np.sqrt(weight) / np.sqrt(weight).mean()
    above = grades[:, None] > np.arange(top)[None, :]
    params = np.concatenate([w, free])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, 401):
        w, free = params[:len(chosen)], params[len(chosen):]
        t = free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]
        score = np.bincount(owner, w[column], minlength=len(grades))
        p = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -30, 30)))  # P(grade > k)
        # likelihood of a grade: P(> g - 1) - P(> g)
        full = np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))])
        at = np.arange(len(p))
        upper, lower = full[at, grades], full[at, grades + 1]
        chance = np.maximum(upper - lower, 1e-12)
        slope = p * (1 - p)
        padded = np.hstack([np.zeros((len(p), 1)), slope, np.zeros((len(p), 1))])
        d_score = -weight * (padded[at, grades] - padded[at, grades + 1]) / chance
        d_t = np.zeros(top)
        for k in range(top):
            sign = np.where(grades == k + 1, 1.0, 0.0) - np.where(grades == k, 1.0, 0.0)
            d_t[k] = (weight * sign * slope[:, k] / chance).sum()
        g_w = np.bincount(column, d_score[owner], minlength=len(chosen)) + ridge * w
        tail = np.cumsum(d_t[::-1])[::-1]
        g_free = np.r_[tail[0], tail[1:] * np.exp(free[1:])]
        g = np.concatenate([g_w, g_free])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 * min(1.0, (401 - step) / 200)
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    free = params[len(chosen):]
    return Model(chosen, params[:len(chosen)], free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))], 0.0)


def graded_text(text: Column, model: Model, good: int = GOOD) -> Column:
    """struct<expected, tail>: expected grade, and the probability of at least `good`."""

    @pandas_udf("expected double, tail double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features()
        for texts in batches:
            if len(model.thresholds):
                p = np.array([model.score(features.of(t)) for t in texts]).reshape(len(texts), -1)
                tail = p[:, good - 1] if good <= p.shape[1] else np.zeros(len(texts))
                yield pd.DataFrame({"expected": p.sum(axis=1), "tail": tail})
            else:
                yield pd.DataFrame({"expected": np.full(len(texts), model.base), "tail": np.full(len(texts), float(model.base >= good))})

    return of(text)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out of the fit."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    grades = graded(labels)
    model = fit(*fit_rows(docs, grades.where(fold(F.col("doc_id")) != 1)))
    small_batches(spark)
    scored = docs.select("doc_id", (fold(docs["doc_id"]) == 1).alias("held_out"), graded_text(docs["text"], model).alias("g"))
    return scored.select(
        "doc_id", "held_out", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("tail_probability"), (F.col("g.tail") >= KEEP).alias("keep")
    )


by_value(__name__)
