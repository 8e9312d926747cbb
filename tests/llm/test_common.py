"""Shared pieces of the operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import common


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_before_is_a_running_sum_and_a_running_maximum(spark, n):
    v = [random.Random(n).randint(-5, 50) for _ in range(n)]
    df = spark.createDataFrame([(v,)], "v array<int>")
    r = df.select(common.before(F.col("v"), lambda a, b: a + b, 0).alias("s"), common.before(F.col("v"), F.greatest, 7).alias("m")).first()
    assert r.s == [0, *itertools.accumulate(v)][:n] and r.m == [7, *itertools.accumulate([7, *v], max)][1:][:n]


def test_free_name():
    assert common.free_name(["a", "B"], "c") == "c" and common.free_name(["a", "B", "b_"], "b") == "b__"
