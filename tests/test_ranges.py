"""Points in ranges: by rule and by operator, against all pairs, whatever a cell holds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimloom import FactSpace, evaluate
from claimloom.operators import paths
from claimloom.plans import ranges

ODD = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, -1e300, 1e-300, 2.0**53, 2.0**70]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 7)
    monkeypatch.setattr(ranges, "SLICE", 3)


def ge(a, b):
    """Spark's order: NaN is equal to itself and above all else."""
    return math.isnan(a) or (not math.isnan(b) and a >= b)


def test_rule_with_a_number_between_two_others_is_no_nested_loop(spark, small_blocks):
    rng = random.Random(3)
    points = [(k, rng.choice([*ODD, rng.uniform(-9, 9), float(rng.randrange(-9, 9))])) for k in range(150)] + [(900, None), (7, 3.0), (7, 3.0)]
    spans = [(k, lo, rng.choice([*ODD, lo, lo + 0.25, lo + 3, lo + 40])) for k in range(60) for lo in [rng.choice([*ODD, float(rng.randrange(-9, 9))])]] + [(901, None, 1.0), (902, 1.0, None)]
    facts = FactSpace(spark, {"at": spark.createDataFrame(points, "p int, x double"), "span": spark.createDataFrame(spans, "r int, lo double, hi double")})
    at, span = ("pred", "at", ["$p", "$x"]), ("pred", "span", ["$r", "$lo", "$hi"])
    known = [(p, x, r, lo, hi) for p, x in points for r, lo, hi in spans if None not in (x, lo, hi)]
    for ops, test in ((("ge", "le"), lambda x, lo, hi: ge(x, lo) and ge(hi, x)), (("gt", "lt"), lambda x, lo, hi: not ge(lo, x) and not ge(x, hi))):
        want = sorted({(p, r) for p, x, r, lo, hi in known if test(x, lo, hi)})
        for body in ([at, span], [span, at]):
            got = evaluate(facts, [*body, (ops[0], "$x", "$lo"), (ops[1], "$x", "$hi")], ["$p", "$r"])
            assert sorted(map(tuple, got.collect())) == want
            assert "_cell" in got._jdf.queryExecution().optimizedPlan().toString()


def test_bag_of_a_rule_counts_equal_facts(spark, small_blocks):
    facts = FactSpace(spark, {"at": spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "p int, x long"), "span": spark.createDataFrame([(0, 5, 6)] * 2 + [(1, 6, 2**62)], "r int, lo long, hi long")})
    of = [("pred", "at", ["$p", "$x"]), ("pred", "span", ["$r", "$lo", "$hi"]), ("le", "$lo", "$x"), ("ge", "$hi", "$x")]
    assert evaluate(facts, [("eq", "$n", ("count", None, of))], ["$n"]).collect()[0][0] == 7


def test_pairs_tested_grow_with_the_result(spark):
    p = spark.range(3000).select("id", F.col("id").alias("x"))
    r = spark.range(3000).select(F.col("id").alias("r"), F.col("id").alias("lo"), (F.col("id") + F.col("id") % 8).alias("hi"))
    tested = ranges.by_length(p, r, "x", "lo", "hi")
    hits = tested.where("x BETWEEN lo AND hi").count()
    assert hits <= tested.count() <= 4 * hits  # of 9,000,000 pairs


def test_one_cell_is_dealt_out(spark, small_blocks):
    p, r = spark.range(60).select("id", (F.col("id") % 5).alias("at")), spark.range(45).select(F.col("id").alias("r"), (F.col("id") % 3).alias("lo"), (F.col("id") % 3 + 1).alias("hi"))
    got = paths.range_join(p, r, "at", "lo", "hi", 100).withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert sorted((x["id"], x["r"]) for x in rows) == sorted((a, b) for a in range(60) for b in range(45) if b % 3 <= a % 5 <= b % 3 + 1)
    assert len({x["task"] for x in rows}) > 1
