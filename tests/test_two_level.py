"""Recursions and lagged products in two levels, against loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import regress as R
from tapeworks.operators import volatility as Y


@pytest.mark.parametrize("segment", [1, 7, 50, 1000])
def test_ewma_series_by_doubling(spark, segment):
    rnd = random.Random(segment)
    rows, want = [], {}
    for s, n in (("a", 400), ("b", 1), ("c", 37)):
        h, bar = None, 0
        for _ in range(n):
            bar += rnd.choice([1, 1, 2, 30])
            r = rnd.gauss(0, 1)
            h = r * r if h is None else h
            h = 0.9 * h + 0.1 * r * r
            rows.append((s, bar, r))
            want[s, bar] = h
    rows.append(("a", 10_000, None))
    got = {(r["symbol"], r["bar"]): r["h"] for r in Y.ewma_series(spark.createDataFrame(rows, "symbol string, bar long, r double"), 0.9, segment).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_garch_on_overlapping_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(s, int(b), float(r)) for s in "ab" for b, r in enumerate(rng.normal(size=130) * 0.01) if b % 11] + [("flat", b, 0.0) for b in range(60)] + [("short", 3, 0.1)]
    want = {}
    for s in ("a", "b", "flat", "short"):
        for c in range(-1, 6):
            part = sorted((b, r) for k, b, r in rows if k == s and c * 20 <= b < (c + 2) * 20)
            if len(part) < 15:
                continue
            v, best = float(np.var([r for _, r in part])), None
            for al, be in Y.GARCH_GRID if v > 0 else []:
                hs, last = [], v
                for _, r in part:
                    hs.append(last)
                    last = v * (1 - al - be) + al * r * r + be * last
                ll = sum(math.log(h) + r * r / h for h, (_, r) in zip(hs, part))
                if best is None or ll < best[0]:
                    best = ll, hs
            for (b, _), h in zip(part, best[1] if best else [v] * len(part)):
                want[s, b] = h  # a later chunk replaces an earlier one's
    got = {(r["symbol"], r["bar"]): r["garch_h"] for r in Y.garch11(spark.createDataFrame(rows, "symbol string, bar long, r double"), 40, 15).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


@pytest.mark.parametrize("lag,segment", [(0, 50), (1, 7), (5, 7), (9, 4), (12, 1000)])
def test_hac_with_halos(spark, lag, segment):
    rng = np.random.default_rng(5)
    n = 240
    x, y = rng.normal(size=n), np.cumsum(rng.normal(size=n)) * 0.1
    X = np.c_[np.ones(n), x]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    sc = X * (y - X @ beta)[:, None]
    s = sc.T @ sc
    for j in range(1, lag + 1):
        g = sc[j:].T @ sc[:-j]
        s += (1 - j / (lag + 1)) * (g + g.T)
    inv = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(inv @ s @ inv))
    df = spark.createDataFrame([(i * 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y double").repartition(3)
    got = {r["term"]: (r["coef"], r["se"]) for r in R.ols_hac(df, "y", ["x"], ["t"], lag=lag, segment=segment).collect()}
    assert got["const"] == pytest.approx((beta[0], se[0])) and got["x"] == pytest.approx((beta[1], se[1]))


def test_cascade_sorts_its_rows_once(spark, monkeypatch):
    """All models that share their rows share a sort of them; one with nulls of its own has its own rows."""
    rng = np.random.default_rng(8)
    n = 400
    a, b, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 3, n)
    y = a + 0.3 * b + g + np.cumsum(rng.normal(size=n)) * 0.1
    rows = [(i, float(a[i]), float(b[i]), float(y[i]), f"g{g[i]}") for i in range(n)]
    sorts, plain = [], R.numbered
    monkeypatch.setattr(R, "numbered", lambda *args: sorts.append(1) or plain(*args))
    df = spark.createDataFrame(rows, "t long, a double, b double, y double, g string").repartition(3)
    got = {r["term"]: (r["coef"], r["se"]) for r in R.cascade(df, "y", {"one": ["a"], "two": ["b"]}, [["g"]], ["t"]).where("model = 'joint+g'").collect()}
    assert len(sorts) == 1

    def newey_west(x, y, lag):
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        s = x * (y - x @ beta)[:, None]
        m = s.T @ s
        for j in range(1, lag + 1):
            c = s[j:].T @ s[:-j]
            m += (1 - j / (lag + 1)) * (c + c.T)
        inv = np.linalg.inv(x.T @ x)
        return beta, np.sqrt(np.diag(inv @ m @ inv))

    beta, se = newey_west(np.c_[np.ones(n), a, b, g == 1, g == 2], y, R.hac_lag(n))
    for i, term in enumerate(["const", "a", "b", "fe0_1", "fe0_2"]):
        assert got[term] == pytest.approx((beta[i], se[i]))
    holes = df.withColumn("b", F.when(F.col("t") % 5 != 0, F.col("b")))
    got = {(r[0], r[1]): (r[2], r[3], r[7]) for r in R.hac_models(holes, "y", {"all": ["a"], "part": ["a", "b"]}, ["t"], lag=6, segment=30)}
    keep = np.arange(n) % 5 != 0
    for model, x, z in (("all", np.c_[np.ones(n), a], y), ("part", np.c_[np.ones(n), a, b][keep], y[keep])):
        beta, se = newey_west(x, z, 6)
        assert got[model, "a"] == pytest.approx((beta[1], se[1], len(z)))


def test_exposure_by_one_sort(spark, monkeypatch):
    """Steps of exposure, totals and numbers equal plain windows whatever the buckets; no join brings sums to rows; numbered rows aren't sorted for the errors."""
    from tapeworks.operators import fills as X

    rng = np.random.default_rng(4)
    rows = [(f"t{rng.integers(0, 4)}", int(rng.integers(0, 60)), int(rng.integers(0, 2)), "BUY" if rng.random() < 0.5 else "SELL", float(i % 7 + 1), 0.1 + i / 500) for i in range(200)]
    df = spark.createDataFrame(rows, "token_id string, block_number long, log_index long, side string, size double, price double").repartition(3)
    held, last, total, want = {}, {}, 0.0, []
    for token, block, log, side, size, price in sorted(rows, key=lambda r: (r[1], r[2], r[0], r[4], r[5], r[3])):
        held[token] = held.get(token, 0.0) + (size if side == "BUY" else -size)
        now = abs(held[token]) * price
        total, last[token] = total + now - last.get(token, 0.0), now
        want.append((price, held[token], total))
    for width in (7, 1000):
        got = X.total_exposure(X.exposure_steps(df, width), width, "at").orderBy("at").collect()
        assert [r["at"] for r in got] == list(range(1, 201))
        assert [x for r in got for x in (r["price"], r["position"], r["total_exposure"])] == pytest.approx([x for w in want for x in w])
    assert "Join" not in X.total_exposure(X.exposure_steps(df))._jdf.queryExecution().optimizedPlan().toString()
    d = X.total_exposure(X.exposure_steps(df, 7), 7, "at").select("at", "price", "position", "total_exposure").cache()
    plain = R.ols_hac(d, "price", ["position", "total_exposure"], ["at"], lag=5, segment=30).collect()
    sorts, numbered = [], R.numbered
    monkeypatch.setattr(R, "numbered", lambda *args: sorts.append(1) or numbered(*args))
    got = R.ols_hac(d, "price", ["position", "total_exposure"], ["at"], lag=5, segment=30, number="at").collect()
    assert not sorts and [r["se"] for r in got] == pytest.approx([r["se"] for r in plain])
    holes = d.withColumn("price", F.when(F.col("at") % 5 != 0, F.col("price")))
    assert [r["n"] for r in R.ols_hac(holes, "price", ["position"], ["at"], lag=5, number="at").collect()] == [160, 160] and sorts
