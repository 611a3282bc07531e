"""Deep pages, quantiles by sketch, trigram postings, event-time frames, grouping sets."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from conftest import SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions.columns import text_match
from quillstone.operators import cleaning as K
from quillstone.operators import paging, postings, rolling
from quillstone.operators import views as V
from quillstone.plans.context import Ledger
from quillstone.session import scratch_path


# deep pages

@pytest.mark.parametrize(("descending", "kind"), [(True, "number"), (False, "text")])
def test_pages_by_rank(spark, descending, kind):
    """Ties, nulls, every place of the listing, small targets: equal to the sorted list."""
    rng = random.Random(4)
    value = (lambda: rng.choice([None, rng.randrange(40), 7, 7])) if kind == "number" else (lambda: rng.choice([None, f"k{rng.randrange(30)}", "same"]))
    rows = [(i, value()) for i in range(700)]
    df = spark.createDataFrame(rows, f"id long, v {'int' if kind == 'number' else 'string'}").repartition(4).cache()
    known = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
    if descending:
        known = sorted(sorted(known), key=lambda r: r[1], reverse=True)
    nulls = sorted((r for r in rows if r[1] is None), key=lambda r: r[0])
    order = known + nulls if descending else nulls + known
    for offset in (333, 690, 5000):
        got = [tuple(r) for r in paging.page_by_rank(df, "v", "id", descending, offset, 20, target=25).collect()]
        assert got == order[offset:offset + 20]


def test_a_deep_page_sorts_few_rows(spark):
    """The sorted piece of a page far down holds at most the target, and the plan's limit is not offset + page."""
    df = spark.range(200_000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))
    piece, below, held = paging.piece_with(df, paging.Order("v", "id", True), 150_000, 2000)
    assert held <= 2000 and piece.count() == held and below <= 150_000 < below + held
    page = paging.page_by_rank(df, "v", "id", True, 150_000, 15, 2000)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "150015" not in plan and [tuple(r) for r in page.collect()] == [tuple(r) for r in df.orderBy(F.desc("v"), "id").offset(150_000).limit(15).collect()]


def test_pages_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, 5)] * 300 + [(2, 5)], "id long, v int")
    assert [tuple(r) for r in paging.page_by_rank(df, "v", "id", True, 290, 20, target=10).collect()] == [(1, 5)] * 10 + [(2, 5)]
    assert paging.page_by_rank(df.limit(0), "v", "id", True, 0, 20).count() == 0


# quantiles

@pytest.mark.parametrize("bins", [K.FEW, 50])
def test_quantiles_are_exact(spark, bins):
    """Skewed, tied, tiny and huge values, few and many distinct ones, in two passes and in three."""
    rng = random.Random(6)
    data = {
        "a": [rng.lognormvariate(0, 4) for _ in range(5000)], "b": [float(rng.randrange(3)) for _ in range(5000)],
        "c": [rng.choice([None, math.nan, rng.random() * 1e-300, -1e300]) for _ in range(5000)], "d": [None] * 4999 + [2.5],
    }
    frame = pd.DataFrame(data)
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), "a double, b double, c double, d double").repartition(5).cache()
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = K.exact_quantiles(df, list(data), probs, bins=bins)
    for c in data:
        expected = [frame[c].astype(float).quantile(p) for p in probs]
        assert got[c] == pytest.approx(expected, rel=1e-12, abs=0), c


@pytest.mark.parametrize("bins", [K.FEW, 10])
def test_quantiles_read_the_data_twice(spark, bins):
    """One pass sketches, one counts, whatever the values; further steps read the counted values only."""
    n, read = 20_000, spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    base = spark.range(n).select(F.exp(F.randn(3) * 8).alias("x"), F.rand(4).alias("y"))
    got = K.exact_quantiles(base.mapInArrow(watched, base.schema), ["x", "y"], [0.25, 0.75], bins=bins)
    assert read.value == 2 * n
    frame = base.toPandas()
    assert got["x"] == pytest.approx([frame.x.quantile(p) for p in (0.25, 0.75)], rel=1e-12)


def test_a_wrong_sketch_costs_a_pass_and_no_result(spark, monkeypatch):
    monkeypatch.setattr(K, "SKETCH_ERROR", 1e-9)
    monkeypatch.setattr(K, "SKETCH_K", 8)
    df = spark.range(20_000).select(F.rand(1).alias("x")).cache()
    frame = df.toPandas()
    assert K.exact_quantiles(df, ["x"], [0.1, 0.5, 0.9])["x"] == pytest.approx([frame.x.quantile(p) for p in (0.1, 0.5, 0.9)], rel=1e-12)


# trigrams

@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    words = ["Nation_1", "NATION_10", "a", "", "ab", "été", "x%y_z", "aaaa", None, "naşan", "one two"]
    rows = [(i, rng.choice(words), rng.choice(words) if rng.random() < 0.5 else f"v{rng.randrange(10**6)}") for i in range(800)]
    return spark.createDataFrame(rows, "id long, p string, q string").cache()


def test_search_by_trigrams_equals_the_scan(spark, texts):
    root = postings.build(texts, "id", ["p", "q"], scratch_path(spark, "test-trigrams"), buckets=8)
    for query in ("NATION_10", "a", "aa", "aaaaa", "é", "%y_", "zzzzz", "", "e t", "\x1f"):
        got = sorted(r.id for r in postings.search(texts, "id", ["p", "q"], root, query).collect())
        assert got == sorted(r.id for r in texts.where(text_match(["p", "q"], query)).collect()), query


def test_only_candidates_are_checked(spark, texts):
    root = postings.build(texts, "id", ["p", "q"], scratch_path(spark, "test-candidates"), buckets=8)
    found = postings.candidates(spark, root, "nation_10")
    scan = texts.where(text_match(["p", "q"], "nation_10")).count()
    assert scan <= found.count() <= texts.where(text_match(["p", "q"], "nation")).count()
    assert postings.candidates(spark, root, "zzz").count() == 0 and postings.candidates(spark, root, "") is None
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan


# event-time frames

@pytest.mark.parametrize("parts", [1, 5, 40])
def test_frames_in_event_time(spark, parts):
    """Hot instants and a hot day, gaps, null times: equal to the window over one partition."""
    rng = random.Random(parts)
    t0 = dt.datetime(2024, 3, 1)
    hot = [t0 + dt.timedelta(days=9, seconds=rng.randrange(86_400)) for _ in range(600)] + [t0 + dt.timedelta(days=9)] * 200
    times = hot + [t0 + dt.timedelta(days=rng.randrange(60), seconds=rng.choice([0, 1, 86_399])) for _ in range(300)] + [None] * 3
    df = spark.createDataFrame([(i, t, rng.randrange(5)) for i, t in enumerate(times)], "id long, t timestamp_ntz, v long").repartition(3).cache()
    got = rolling.rolling_range(df, "t", {"v": F.col("v")}, 6 * 86_400, parts)
    plain = Window.orderBy(F.unix_micros(F.col("t").cast("timestamp"))).rangeBetween(-6 * 86_400 * 10**6, 0)
    expected = df.select("id", F.sum("v").over(plain).alias("s"), F.count(F.lit(1)).over(plain).alias("n"))
    assert sorted((r.id, r._sum_v, r._rows) for r in got.collect()) == sorted((r.id, r.s, r.n) for r in expected.collect())


def test_no_window_over_all_rows(spark):
    """The windows over one partition read one row a range, not the rows."""
    df = spark.range(5000).select(F.timestamp_add("SECOND", F.col("id") * 977, F.lit("2024-01-01").cast("timestamp_ntz")).alias("t"), F.lit(1).cast("long").alias("v"))
    run = rolling.running_sums(df, ["t"], ["v"], parts=16)
    assert run.agg(F.max("_run_v")).first()[0] == 5000
    offsets = run._jdf.queryExecution().optimizedPlan().toString()
    assert offsets.count("Window") == 2


# grouping sets

def test_grouping_sets_equal_the_views(spark):
    led = Ledger(spark, SF_SMALL, materialize=True)
    got = V.grouped_summary(led.accounts, led.segments, led.tx)
    months = {(r.month, r.transaction_count, r.total_value) for r in V.monthly_summary(led.tx).collect()}
    assert {(r.month, r.transaction_count, r.total_value) for r in got.where("grouping = 23").collect()} == months
    channels = {(r.channel, r.transaction_count, r.transaction_value) for r in V.channel_performance(led.tx).collect()}
    assert {(r.channel, r.transaction_count, r.total_value) for r in got.where("grouping = 30").collect()} == channels
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
