"""Key checks over appended batches: equal to the full check, and only the batch is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import constraints as CK
from quillstone.operators.key_index import KeyIndex, unique_over_batches
from quillstone.session import scratch_path


def index(spark, name, keys, **more):
    import uuid
    return KeyIndex(spark, scratch_path(spark, f"{name}-{uuid.uuid4().hex}"), keys, **{"buckets": 4, **more})


@pytest.mark.parametrize("bits", [64, 1 << 14])
def test_unique_over_batches(spark, bits):
    """Repeats within a batch and between any two, nulls, a tiny filter full of false positives."""
    rng = random.Random(bits)
    rows = [(i, rng.choice([None, rng.randrange(150)]), rng.choice(["a", None, "b"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k int, t string").cache()
    batches = [(f"b{i}", df.where(F.pmod("id", F.lit(4)) == i)) for i in range(4)]
    got = unique_over_batches(index(spark, "test-unique", ["k", "t"], bits=bits), batches)
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(CK.check_unique(df, ["k", "t"]).collect(), key=key)


def test_foreign_keys_over_batches(spark):
    found = index(spark, "test-foreign", ["account_id"])
    found.add(spark.range(0, 100, 2).selectExpr("id account_id"), "p0")
    found.add(spark.range(1, 60, 2).selectExpr("id account_id"), "p1")
    children = spark.range(0, 130).selectExpr("id", "if(id = 7, null, id) account_id")
    assert sorted(r.id for r in found.missing(children).collect()) == [*range(61, 100, 2), *range(100, 130)]


def test_only_the_batch_is_shuffled(spark):
    """The plans read filters and keys in their buckets: no exchange above either scan."""
    found = index(spark, "test-plan", ["k"])
    for i in range(3):
        found.add(spark.range(i * 1000, i * 1000 + 1000).selectExpr("id k"), f"b{i}")
    per = found.counted(spark.range(2900, 3100).selectExpr("id k"))
    lines = found.candidates(per)._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(lines) if "_filters" in line and "Scan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above = [line for i, line in enumerate(lines[:scan]) if depth(line) < depth(lines[scan]) and all(depth(x) >= depth(line) for x in lines[i + 1:scan + 1] if x.strip())]
    assert not any("Exchange" in line for line in above), above
    assert found.candidates(per).count() < 130  # 100 are there; false positives are few
    assert found.earlier(per).count() == 100
