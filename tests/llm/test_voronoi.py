"""Op 1 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import voronoi


def brute(rows, k):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    data = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in data if i % 20 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in data if i != q)  # noqa: B905
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def run(spark, rows, k=20, **how):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cell int, v int")
    df = df.select("vec_id", voronoi.integers().alias("v"))
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in voronoi.nearest(df, F.col("vec_id") % 20 == 0, k, **how).collect()]


@pytest.mark.parametrize("kind", ["uniform", "clusters", "few", "odd"])
def test_equals_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(9)
    n = {"few": 15}.get(kind, 700)
    v = rng.normal(size=(n, 6)).astype("f4")
    if kind == "clusters":
        v = (v * 0.05 + rng.normal(size=(8, 6))[rng.integers(0, 8, n)]).astype("f4")
        v[:250] = v[0]  # a hot vector
        monkeypatch.setattr(voronoi, "QUERIES", 5)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    if kind == "odd":
        rows += [(None, rows[0][1]), (20, None), (40, []), (60, [1.0, None]), (80, [float("nan")] * 6), (100, [float("inf")] * 6), (1001, [0.5]), rows[3], (7, rows[9][1]), (160, rows[5][1]), rows[160]]
    got = run(spark, rows)
    assert len(got) == len(set(got)) or kind == "odd"
    assert set(got) == brute(rows, 20)


def share(spark, rows, **how):
    """Share of (row, group of queries) pairs that the bounds leave."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", voronoi.integers().alias("v"))
    placed, _, n, _, bounds, _ = voronoi.plan(df, F.col("vec_id") % 20 == 0, 5, **how)
    at = placed.select("cell", "far").toPandas()
    return sum(len(bounds.needed(g, at.cell.to_numpy(), at.far.to_numpy())) for g in range(len(bounds.low))) / (n * len(bounds.low))


def test_bounds_prune(spark, monkeypatch):
    # far clusters on a sphere, of equal norms: a group of queries needs the rows of its own cluster and few others
    monkeypatch.setattr(voronoi, "QUERIES", 5)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    v = centres[rng.integers(0, 8, 800)] * 6 + rng.normal(size=(800, 16)) * 0.05
    v = 3 * v / np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    assert set(run(spark, rows, 5, pivots=32)) == brute(rows, 5)
    assert share(spark, rows, pivots=32) < 0.35
    # repeated ids widen the bounds by as many rows and do not end them
    assert share(spark, rows + rows[::7], pivots=32) < 0.4
    assert set(run(spark, rows + rows[::7], 5, pivots=32)) == brute(rows + rows[::7], 5)


def test_one_query_of_very_many_rows_leaves_the_bounds_of_others(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "QUERIES", 5)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    v = centres[rng.integers(0, 8, 800)] * 6 + rng.normal(size=(800, 16)) * 0.05
    v = 3 * v / np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    many = rows + [rows[20]] * 300
    assert share(spark, many, pivots=32) < 0.5
    assert set(run(spark, many, 5, pivots=32)) == brute(many, 5)


def test_empty_and_large_values(spark):
    rng = np.random.default_rng(2)
    assert run(spark, [], 5) == []
    rows = [(i, [1.0, 2.0]) for i in range(1, 20)]
    assert run(spark, rows) == []
    big = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 1e6]) for i in range(90)]
    assert set(run(spark, big, 4, pivots=12)) == brute(big, 4)
