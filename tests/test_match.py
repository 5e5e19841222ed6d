"""Twin metrics, refined profiles, permutations and live quotes against loops and NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import levels as L
from tapeworks.operators import regress as R
from tapeworks.operators import twin as W


def test_aligned_paths(spark):
    rnd = random.Random(3)
    sides = [[(k, rnd.randrange(400), float(rnd.choice([-2, -1, 1, 3]))) for k in "abc" for _ in range(n)] for n in (40, 25)]
    a, b = (spark.createDataFrame(x, "token_id string, t_ns long, signed_size double") for x in sides)
    want = []
    for k in "abc":
        times = sorted({t for s in sides for j, t, _ in s if j == k})
        for t, u in zip(times, times[1:]):
            want.append((k, t, u, *(sum(x for j, v, x in s if j == k and v <= t) for s in sides)))
    paths = W.aligned_paths(a, b, width=37)
    assert sorted(map(tuple, paths.collect())) == want
    x, y, w = (np.array(v, float) for v in ([r[3] for r in want], [r[4] for r in want], [r[2] - r[1] for r in want]))
    cov = np.cov(x, y, aweights=w, ddof=0)
    got = paths.agg(W.weighted_corr(F.col("x"), F.col("y"), F.col("until") - F.col("t_ns")).alias("c")).first()["c"]
    assert got == pytest.approx(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]))


def test_match_metrics_of_itself_and_of_nothing(spark):
    rows = [("a", i * 10**12, 1.0 if i % 3 else -2.0, i % 2 == 0, float(i - 4), i > 5) for i in range(12)]
    df = spark.createDataFrame(rows, "token_id string, t_ns long, signed_size double, is_maker boolean, net double, won boolean")
    got = {r["metric"]: r for r in W.match_metrics(df, df).collect()}
    assert set(got) == set(W.TARGETS) and all(r["passed"] for r in got.values()) and got["position_pearson"]["gap"] == pytest.approx(1)
    none = {r["metric"]: r for r in W.match_metrics(df, df.where("false")).collect()}
    assert not none["fill_time_ks"]["passed"] and not none["position_pearson"]["passed"] and none["fills"]["gap"] == 1


def test_profile_refined(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 5, 400)
    y = 3.3 + 1.7 * x + rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = R.profile_refined(df, F.col("y") - F.col("level") - F.col("slope") * F.col("x"), {"slope": (-4.0, 4.0), "level": (0.0, 20.0)}, 0.01)
    best = got.orderBy(F.desc("loglik")).first()
    slope, level = np.polyfit(x, y, 1)
    assert abs(best["slope"] - slope) < 0.05 and abs(best["level"] - level) < 0.1 and best["inside"]
    v = np.mean((y - level - slope * x) ** 2)
    assert 0 <= -200 * (np.log(2 * np.pi * v) + 1) - best["loglik"] < 0.1
    top = best["loglik"]
    assert all(r["inside"] == (top - r["loglik"] <= 1.92) for r in got.collect())


def test_permuted_is_a_permutation(spark):
    df = spark.createDataFrame([(i, float(i % 17), i * 2) for i in range(500)], "k long, x double, y long")
    got = R.permuted(df, "x", ["k"]).collect()
    assert sorted(r["k"] for r in got) == list(range(500)) and all(r["y"] == 2 * r["k"] for r in got)
    assert sorted(r["x"] for r in got) == sorted(float(i % 17) for i in range(500)) and sum(r["x"] == r["k"] % 17 for r in got) < 80
    assert got == R.permuted(df.repartition(5), "x", ["k"]).collect() or sorted(got) == sorted(R.permuted(df.repartition(5), "x", ["k"]).collect())


def test_gbt_by_group_and_permutation_importance(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b), float(5 * a + (0.1 if i % 3 else 2.0) * e), "noisy" if i % 3 == 0 else "calm", i < 700) for i, (a, b, e) in enumerate(zip(rng.uniform(size=1000), rng.uniform(size=1000), rng.normal(size=1000)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double, g string, train boolean")
    measures, importance = R.gbt_residual(df, "y", ["b", "a"], ["k"], "g", rounds=20, step=0.3)
    m = {(r["part"], r["group"]): r for r in measures.collect()}
    assert set(m) == {("train", "all"), ("test", "all"), ("test", "noisy"), ("test", "calm")} and m["test", "all"]["n"] == 300
    assert m["test", "noisy"]["ratio"] > 1 > m["test", "calm"]["ratio"] and m["test", "all"]["ratio"] == pytest.approx(m["test", "all"]["rmse"] / m["train", "all"]["rmse"])
    top = importance.orderBy("rank").first()
    assert top["feature"] == "a" and top["importance"] > 0.9 and top["in_core"]


def test_fill_while_live(spark):
    lv = [("k", "0.5", "BUY", 10, 5.0, "new_order"), ("k", "0.5", "BUY", 20, 0.0, "cancel_or_fill"), ("k", "0.5", "BUY", 30, 4.0, "new_order"), ("k", "0.5", "BUY", 60, 7.0, "new_order"), ("k", "0.6", "SELL", 95, 1.0, "new_order"), ("o", "0.5", "BUY", 10, 1.0, "new_order")]
    levels = spark.createDataFrame(lv, "token_id string, price string, side string, t_recv_ns long, size double, classification string")
    fills = spark.createDataFrame([("k", "0.5", 25), ("k", "0.5", 34), ("k", "0.5", 75), ("k", "0.6", 96), ("o", "0.5", 12)], "token_id string, price string, t_ns long")
    closes = spark.createDataFrame([("k", 70)], "token_id string, t_close_ns long")
    got = {(r["token_id"], r["price"], r["t_ns"]): (r["live_until_ns"], r["filled"]) for r in L.fill_while_live(levels, fills, closes, 20, width=15).collect()}
    assert got == {("k", "0.5", 10): (20, False), ("k", "0.5", 30): (70, True), ("k", "0.5", 60): (70, False), ("o", "0.5", 10): (None, True)}


def test_kfold_is_a_crc(spark):
    import zlib

    got = R.kfold(spark.createDataFrame([(f"m{i}",) for i in range(200)], "market string"), "market").collect()
    assert all(r["fold"] == zlib.crc32(r["market"].encode()) % 5 for r in got) and {r["fold"] for r in got} == set(range(5))


def test_logit_against_newton(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 2))
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-(0.4 + x @ [1.2, -0.7])))).astype(float)
    X, b = np.c_[np.ones(600), x], np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-X @ b))
        b += np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X, X.T @ (y - p))
    got = {r["term"]: r["coef"] for r in R.logit(spark.createDataFrame([(*map(float, u), float(v)) for u, v in zip(x, y)], "a double, b double, y double"), "y", ["a", "b"]).collect()}
    assert [got["const"], got["a"], got["b"]] == pytest.approx(b.tolist(), abs=1e-4)


def test_aligned_paths_of_large_and_null_keys(spark):
    """A key of most rows is dealt by buckets, null is a key, and the rows are shuffled for the two readers of one table, not once a step."""
    rows = [(None if i % 11 == 0 else "big" if i % 7 else f"k{i}", i * 5 % 997, float(i % 5 - 2)) for i in range(1, 600)]
    a = spark.createDataFrame(rows, "token_id string, t_ns long, signed_size double")
    paths = W.aligned_paths(a, a.where("t_ns % 2 = 0"), width=40)
    assert paths._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 5
    want = {}
    for key in {r[0] for r in rows}:
        times = sorted({r[1] for r in rows if r[0] == key})
        for t, until in zip(times, times[1:]):
            own = [r for r in rows if r[0] == key and r[1] <= t]
            want[key, t] = (until, sum(r[2] for r in own), sum(r[2] for r in own if r[1] % 2 == 0))
    assert {(r[0], r[1]): tuple(r[2:]) for r in paths.collect()} == want


def test_gbt_measures_permute_nothing_and_deal_small_partitions(spark, monkeypatch, sf):
    """Measures alone don't wait for the importances, and the trees' rows are cached in partitions of bounded size, however few files they come from."""
    from tapeworks.plans.registry import QUERIES

    monkeypatch.setattr(R, "permuted", lambda *a: 1 / 0)
    assert {(r["part"], r["group"]) for r in QUERIES["l9_gbt_by_group"](spark, sf).collect()} >= {("train", "all"), ("test", "all")}
    df = spark.range(1000).select(F.col("id").alias("k")).coalesce(1)
    parts = R.dealt(df, ["k"], rows=50).rdd.glom().map(lambda p: [r[0] for r in p]).collect()
    assert len(parts) == 20 and max(map(len, parts)) < 100 and all(p == sorted(p) for p in parts) and sum(map(len, parts)) == 1000


@pytest.mark.parametrize("query", ["l9_gbt_by_group", "l9_l11_gbt_residual"])
def test_gbt_queries_fit_the_whole_number_of_trees(spark, monkeypatch, sf, query):
    """500 rounds that end after 50 without gain, so 100 are fitted before the first look."""
    import inspect

    from pyspark.ml.regression import GBTRegressor

    from tapeworks.plans.registry import QUERIES

    class Fitted(Exception):
        pass

    def fit(self, rows):
        raise Fitted(self.getMaxIter())

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    with pytest.raises(Fitted) as found:
        QUERIES[query](spark, sf)
    assert found.value.args[0] >= 100
    assert {n: inspect.signature(R.gbt_fit).parameters[n].default for n in ("rounds", "patience")} == {"rounds": 500, "patience": 50}


def test_gbt_fit_of_cells_is_that_of_rows(spark):
    """Rows of equal bins with weights give the trees of the rows; ordered bins stay ordered."""
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(3 * a * a - 2 * a * b + e), i < 1400) for i, (a, b, e) in enumerate(zip(rng.integers(0, 9, 2000), rng.integers(0, 5, 2000), rng.normal(size=2000)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double, train boolean")
    got = {r["k"]: r["y"] - r["__e"] for r in R.gbt_fit(df, "y", ["a", "b"], ["k"], rounds=6, step=0.3, subsample=1.0)(df).collect()}
    model = GBTRegressor(labelCol="y", maxDepth=4, stepSize=0.3, maxIter=6, seed=42).fit(R._assembled(df.where("train"), ["a", "b"]))
    want = {r["k"]: r["prediction"] for r in model.transform(R._assembled(df, ["a", "b"])).collect()}
    assert len(got) == 2000 and [got[k] for k in range(2000)] == pytest.approx([want[k] for k in range(2000)])


def test_gbt_fit_goes_on_until_patience_ends(spark, monkeypatch):
    """A first fit that still gains is followed by all rounds, and the trees after the best are left out; without other rows none are."""
    from pyspark.ml.regression import GBTRegressor

    assert R.best_round([5.0, 4.0, 4.0, 4.5, 3.0], 2) == (2, True) and R.best_round([5.0, 4.0, 4.0, 4.5, 3.0], 3) == (5, False) and R.best_round([1.0], 1) == (1, False)
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(np.sin(6 * a) + e), i < 300) for i, (a, e) in enumerate(zip(rng.uniform(size=400), rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "k long, a double, y double, train boolean")
    tried, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: tried.append(self.getMaxIter()) or fit(self, rows))
    rmse = {n: R.gbt_fit(df, "y", ["a"], ["k"], rounds=n, patience=p)(df).where("not train").agg(R._rmse()).first()[0] for n, p in ((12, 12), (1, 12), (4, 12))}
    assert tried[0] == 12 and all(rmse[12] <= rmse[n] + 1e-12 for n in (1, 4))
    tried.clear()
    R.gbt_fit(df.withColumn("y", F.col("a") * 100), "y", ["a"], ["k"], rounds=9, step=0.3, patience=2)
    assert tried[:2] == [4, 9]
    tried.clear()
    R.gbt_fit(df.where("train"), "y", ["a"], ["k"], rounds=5, patience=1)
    assert tried == [5]
