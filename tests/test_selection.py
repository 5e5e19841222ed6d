"""Percentiles by selection against NumPy; bootstraps against the same weights row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import selection as S

PS = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def samples():
    rng = np.random.default_rng(0)
    tiny = 5e-324
    return {
        "normal": rng.normal(size=501).tolist(), "ties": rng.integers(0, 4, 400).astype(float).tolist(), "constant": [0.1] * 50, "one": [-3.5], "two": [1.0, 2.0],
        "scales": (rng.choice([-1, 1], 300) * 10.0 ** rng.uniform(-300, 300, 300)).tolist(), "close": (1e9 + rng.integers(0, 3000, 400) * 2.0**-22).tolist(),
        "powers": [s * 2.0**k for k in range(-60, 60) for s in (1, -1)] + [math.nextafter(2.0**k, 0) for k in range(-60, 60)], "odd": [0.0, -0.0, tiny, -tiny, 1.7976931348623157e308, -1.7976931348623157e308, 2.2250738585072014e-308],
    }


def test_percentiles_by_group(spark):
    rows = [(k, x) for k, xs in samples().items() for x in xs] + [("normal", None), ("normal", float("nan")), ("nothing", None)] + [(None, float(i)) for i in range(10)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in S.percentiles(df, "v", PS, ["k"]).collect()}
    want = samples() | {None: [float(i) for i in range(10)]}
    assert set(got) == set(want)
    for k, xs in want.items():
        if k != "odd":
            assert [got[k][n] for n in PS] == pytest.approx([float(np.percentile(xs, 100 * p)) for p in PS.values()], rel=1e-14), k
    assert (got["odd"]["p0"], got["odd"]["p50"], got["odd"]["p100"]) == (-1.7976931348623157e308, 0.0, 1.7976931348623157e308)


def test_order_of_parts(spark):
    xs = sorted({x for v in samples().values() for x in v} - {-0.0}) + [float("inf")]
    xs = [float("-inf"), *xs]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, v double").select("i", *[c.alias(n) for c, n in zip(S.order_parts(F.col("v")), S.LEVELS)])
    parts = [tuple(r[n] for n in S.LEVELS) for r in df.orderBy("i").collect()]
    assert all(a < b for a, b in zip(parts, parts[1:]))


def test_whole_table_weights_and_nothing(spark):
    df = spark.createDataFrame([(float(x), x % 3) for x in range(100)], "v double, w int")
    want = np.repeat(np.arange(100.0), np.arange(100) % 3)
    assert tuple(S.percentiles(df, "v", {"a": 0.3, "b": 0.77}, weight=F.col("w")).first()) == pytest.approx(tuple(np.percentile(want, [30, 77])))
    assert [tuple(r) for r in S.percentiles(df.where("false"), "v", {"a": 0.5}).collect()] == [(None,)]
    assert S.percentiles(df, "v", {"a": 0.5}, accuracy=10_000).first()["a"] == pytest.approx(49.5, abs=1)


def test_bootstraps(spark):
    rng = np.random.default_rng(2)
    n, rounds = 700, 60
    rows = [(i, float(x), float(u)) for i, (x, u) in enumerate(zip(rng.normal(size=n), rng.integers(0, 9, n)))]
    df = spark.createDataFrame(rows, "id long, y double, x double").repartition(3)
    keys = np.array([r["k"] for r in df.select("id", F.xxhash64("id").alias("k")).orderBy("id").collect()])
    w = S.poisson_weights(keys, rounds, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    y, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = np.array([np.median(np.repeat(y, w[:, k])) for k in range(rounds)])
    got = {r["round"]: r["median"] for r in S.bootstrap_medians(df, "y", "id", rounds, 42).collect()}
    assert [got[k + 1] for k in range(rounds)] == pytest.approx(want.tolist())
    ties = np.array([np.median(np.repeat(x, w[:, k])) for k in range(rounds)])
    assert tuple(S.bootstrap_ci(df, "x", "id", rounds).first()) == pytest.approx((*np.percentile(ties, [2.5, 50, 97.5]), rounds))
    fits = np.array([np.polyfit(x, y, 1, w=np.sqrt(w[:, k].astype(float))) for k in range(rounds)])
    own = np.polyfit(x, y, 1)
    got = {r["term"]: r for r in S.bias_regression(df, "y", "x", "id", {"const": own[1], "x": 5.0}, rounds).collect()}
    for term, k in (("x", 0), ("const", 1)):
        assert (got[term]["coef"], got[term]["lo"], got[term]["hi"]) == pytest.approx((own[k], *np.percentile(fits[:, k], [2.5, 97.5])))
    assert got["const"]["inside"] and not got["x"]["inside"] and got["x"]["n"] == n
