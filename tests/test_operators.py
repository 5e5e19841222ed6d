"""Operators on small fixtures with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import money as M
from tapeworks.functions import pricing as P
from tapeworks.operators import fills as X
from tapeworks.operators import levels as L
from tapeworks.operators import ordered as O
from tapeworks.operators import regress as R
from tapeworks.operators import volatility as Y
from tapeworks.sources import feeds as S

NS = 10**9


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_norm_price(spark):
    got = column(spark, [("0.61",), ("0.5",), ("1",), ("0",), ("0.6100004",), ("not_a_number",)], "p string", M.norm_price(F.col("p")))
    assert got == ["0.610000", "0.500000", "1.000000", "0.000000", "0.610000", "not_a_number"]


FILLS = "token_id string, block_number long, log_index long, side string, size double, price double"


@pytest.mark.parametrize("rows, expected", [([("BUY", 10.0)], [10]), ([("SELL", 5.0)], [-5]), ([("SELL", 10.0), ("SELL", 5.0), ("BUY", 3.0)], [-10, -15, -12])])
def test_inventory(spark, rows, expected):
    df = spark.createDataFrame([("a", 100 + i, 0, s, q, 0.5) for i, (s, q) in enumerate(rows)], FILLS)
    assert [r["position"] for r in X.inventory_series(df, width=2).orderBy("block_number").collect()] == expected


def test_total_exposure_is_the_sum_of_latest(spark):
    rows = [("a", 1, 0, "BUY", 10.0, 0.5), ("b", 2, 0, "SELL", 4.0, 0.25), ("a", 3, 0, "SELL", 10.0, 0.6), ("b", 9, 0, "BUY", 1.0, 0.5)]
    got = [r["total_exposure"] for r in X.total_exposure(X.inventory_series(spark.createDataFrame(rows, FILLS), 2), 3).orderBy("block_number").collect()]
    assert got == pytest.approx([5.0, 6.0, 1.0, 1.5])


def test_level_matching(spark):
    levels = spark.createDataFrame([("t", "0.500000", "BUY", 1 * NS, 10.0), ("t", "0.500000", "BUY", 5 * NS, 0.0), ("u", "0.500000", "BUY", 5 * NS, 3.0)], "token_id string, price string, side string, t_recv_ns long, size double")
    lv = L.level_changes(levels)
    assert {(r["token_id"], r["t_recv_ns"]): r["classification"] for r in lv.collect()} == {("t", NS): "new_order", ("t", 5 * NS): "cancel_or_fill", ("u", 5 * NS): "new_order"}
    fills = spark.createDataFrame([(1, "t", "0.500000", 6 * NS), (2, "t", "0.500000", 60 * NS), (3, "u", "0.500000", 5 * NS)], "k int, token_id string, price string, t_ns long")
    got = {r["k"]: r["lifetime_ms"] for r in L.quote_lifetime(lv, fills).collect()}
    assert got == {1: 4000.0, 2: None, 3: None}


def test_asof_against_a_loop(spark):
    import random

    random.seed(3)
    left = [(i, random.choice("ab"), random.randrange(0, 400)) for i in range(120)]
    right = [(random.choice("ab"), random.randrange(50, 350), i) for i in range(80)]
    l, r = spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int")
    for name, strict, back in (("asof_backward", False, True), ("latest_before", True, True), ("asof_forward", False, False), ("next_after", True, False)):
        got = {x["i"]: x["rt"] for x in getattr(O, name)(l, r, "t", ["k"], {"rt": "t"}, width=37).collect()}
        for i, k, t in left:
            ts = [s for kk, s, _ in right if kk == k and ((s < t or (s == t and not strict)) if back else (s > t or (s == t and not strict)))]
            assert got[i] == ((max(ts) if back else min(ts)) if ts else None), (name, i)


def test_nearest_prefers_the_earlier(spark):
    l, r = spark.createDataFrame([("a", 10)], "k string, t long"), spark.createDataFrame([("a", 8, 1), ("a", 12, 2)], "k string, t long, v int")
    assert O.asof_nearest(l, r, "t", ["k"], {"v": "v"}, width=5).first()["v"] == 1


def test_overlap_counts_strict_containment(spark):
    df = spark.createDataFrame([(1, "x", 0, 10), (2, "x", 5, 7), (3, "x", 10, 20), (4, "x", 0, 3), (5, "y", 1, 2)], "i int, k string, s long, e long")
    assert {r["i"]: r["n"] for r in O.interval_overlap_count(df, ["k"], "s", "e", "n", 4).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_option_round_trip(spark):
    df = spark.createDataFrame([(100.0, 101.0, 0.001, 0.5), (100.0, 99.0, 0.01, 0.8)], "k double, s double, tau double, sigma double")
    fair = P.fair_value_up(F.col("k"), F.col("s"), F.col("tau"), F.col("sigma"))
    rows = df.withColumn("p", fair).withColumn("back", P.implied_sigma_bounded(F.col("p"), F.col("k"), F.col("s"), F.col("tau"))).collect()
    for r in rows:
        exact = 1 - 0.5 * math.erfc(-math.log(r["k"] / r["s"]) / (r["sigma"] * math.sqrt(r["tau"])) / math.sqrt(2))
        assert r["p"] == pytest.approx(exact, abs=1e-9) and r["back"] == pytest.approx(r["sigma"], abs=1e-6)
    edge = spark.createDataFrame([(0.0, 100.0, 101.0, 0.1), (1.0, 100.0, 101.0, 0.1), (0.6, 100.0, 101.0, 0.0)], "p double, k double, s double, tau double")
    assert [r[0] for r in edge.select(P.implied_sigma_bounded(F.col("p"), F.col("k"), F.col("s"), F.col("tau"))).collect()] == [None] * 3


def test_ewma_series_is_the_recursion(spark):
    rs = [0.01 * ((7 * i) % 11 - 5) for i in range(50)]
    df = spark.createDataFrame([("a", i, r) for i, r in enumerate(rs)], "symbol string, bar long, r double")
    got = [r["h"] for r in Y.ewma_series(df, 0.9, segment=8).orderBy("bar").collect()]
    h, want = rs[0] ** 2, []
    for r in rs:
        h = 0.9 * h + 0.1 * r * r
        want.append(h)
    assert got == pytest.approx(want, rel=1e-9)


def test_hac_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    n = 300
    x = rng.normal(size=n)
    y = 1 + 2 * x + rng.normal(size=n)
    got = {r["term"]: r for r in R.ols_hac(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y double"), "y", ["x"], ["t"], lag=4, segment=50).collect()}
    a = np.column_stack([np.ones(n), x])
    b = np.linalg.solve(a.T @ a, a.T @ y)
    s = a * (y - a @ b)[:, None]
    m = s.T @ s
    for j in range(1, 5):
        g = s[j:].T @ s[:-j]
        m += (1 - j / 5) * (g + g.T)
    inv = np.linalg.inv(a.T @ a)
    se = np.sqrt(np.diag(inv @ m @ inv))
    assert got["x"]["coef"] == pytest.approx(b[1]) and got["x"]["se"] == pytest.approx(se[1], rel=1e-6)


def test_json_lines(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("not json {",), ("  ",), ('{"a": 2, "b": {"c": 1}}',)], "value string")
    got = S.parse_json_lines(df, "a int, b string").collect()
    assert [(r["a"], r["_bad"]) for r in got] == [(1, False), (None, True), (2, False)]
    assert {f.name for f in S.infer_unified_schema(df)} == {"a", "b"}


def test_uint256_words(spark):
    big = 2**255 + 12345
    df = spark.createDataFrame([(f"{7:064x}{big:064x}",)], "d string")
    assert df.select(M.word_unsigned(F.col("d"), 0), M.word_unsigned(F.col("d"), 1)).first()[:] == ("7", str(big))


def test_upsert_and_verified_write(spark, tmp_path):
    from tapeworks.sources import sinks

    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, None)], "k int, v string")
    assert sorted(map(tuple, sinks.upsert_dimension(old, new, "k").collect())) == [(1, "a"), (2, "x"), (3, None)]
    assert sinks.write_verified(old, str(tmp_path / "t")) == 2
    assert sinks.checkpointed(spark, str(tmp_path / "c"), lambda: old).count() == 2
    assert sinks.checkpointed(spark, str(tmp_path / "c"), lambda: 1 / 0).count() == 2
    (tmp_path / "c" / "_SUCCESS").unlink()  # as after a write that failed half-way
    assert sinks.checkpointed(spark, str(tmp_path / "c"), lambda: old.limit(1)).count() == 1
    a, b = spark.createDataFrame([(1, "a", None), (2, None, 5)], "k int, v string, w int"), spark.createDataFrame([(2, "x", 6), (3, "y", None)], "k int, v string, w int")
    assert sorted(map(tuple, sinks.merge_precedence(a, b, "k").collect())) == [(1, "a", None, "primary"), (2, "x", 5, "primary"), (3, "y", None, "fallback")]


def test_cascade_gate(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 300
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    g, h = rng.integers(0, 2, n), rng.integers(0, 3, n)
    y = 2 * a - b + 0.5 * g + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, (a[i], b[i], c[i], y[i])), f"g{g[i]}", int(h[i])) for i in range(n)], "t long, a double, b double, c double, y double, g string, h int")
    fits = R.cascade(df, "y", {"one": ["a", "c"], "two": ["b"]}, [["g"], ["g", "h"]], ["t"])
    r2 = lambda x: 1 - np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2) / np.sum((y - y.mean()) ** 2)
    base = np.c_[np.ones(n), a, b]
    want = {"joint": r2(base), "joint+g": r2(np.c_[base, g]), "joint+g+g*h": r2(np.c_[base, np.array([[x == p and z == q for p in (0, 1) for q in (0, 1, 2)][1:] for x, z in zip(g, h)])])}
    got = {r["model"]: r for r in R.cascade_gate(fits).collect()}
    assert {k: r["r2"] for k, r in got.items()} == pytest.approx(want) and all(r["stable"] and r["passed"] for r in got.values())
    assert not any(r["passed"] for r in R.cascade_gate(fits, 0.9999).collect())


def test_rotation_leaves_the_current_hour(spark, tmp_path):
    from tapeworks.sources import sinks

    for hour in ("03", "04"):
        d = tmp_path / "raw" / "date=2024-01-01" / f"hour={hour}"
        d.mkdir(parents=True)
        (d / "data.jsonl").write_text('{"a": 1}\nbad\n')
    sinks.rotate_completed(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "a int", "2024-01-01T04")
    assert [(r["a"], r["hour"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 3)]


def test_scan_reads_one_day_or_hour(spark, tmp_path):
    from tapeworks.sources.sinks import write_hourly

    rows = [("a", "2024-01-01", "03", 1), ("a", "2024-01-01", "04", 2), ("a", "2024-01-02", "03", 3), ("b", "2024-01-01", "03", 4)]
    at = str(tmp_path / "t")
    write_hourly(spark.createDataFrame(rows, "feed string, date string, hour string, x int"), at)
    ids = lambda d: sorted(r["x"] for r in d.collect())
    assert ids(S.scan_feed(spark, at, "a", "2024-01-01")) == [1, 2]
    one = S.scan_feed(spark, at, "a", "2024-01-01", "04", ["x", "absent"])
    assert one.columns == ["x"] and ids(one) == [2] and len(one.inputFiles()) == 1
    with pytest.raises(FileNotFoundError):
        S.scan_feed(spark, at, "a", "2024-01-03")


def test_chain_logs_of_odd_shape(spark):
    word = lambda n: f"{n:064x}"
    topic = {v: f"0x{k}" for k, v in S.TOPICS.items()}
    who = "0x" + word(0xAB)
    rows = [
        (0, [topic["ConditionResolution"], who, who, who], "0x" + word(3) + word(64) + word(3) + word(1) + word(0) + word(2**255), S.CONDITIONS[0]),
        (1, [topic["ConditionResolution"], who, who, who], "0x" + word(3) + word(64) + word(9) + word(1), S.CONDITIONS[0]),
        (2, [topic["ConditionResolution"], who, who, who], "0x" + word(0) + word(64) + word(0), S.CONDITIONS[0]),
        (3, [topic["OrderFilled"].upper().replace("0X", "0x"), who, who, who], "0x" + "".join(map(word, (1, 2**200, 5, 6, 7, 8, 9))), S.EXCHANGES[1].upper().replace("0X", "0x")),
        (4, [topic["Transfer"], who, who], "0x", S.CASH[0]),
        (5, [topic["Transfer"], who, who], "0x" + word(1), S.CONDITIONS[0]),
        (6, [], None, S.CASH[0]),
        (7, None, "0x", None),
    ]
    logs = spark.createDataFrame(rows, "log_index int, topics array<string>, data string, address string").selectExpr("*", "1L as block_number", "'0x1' as tx_hash")
    got = {r["log_index"]: r for r in S.decode_chain_logs(logs).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert got[0]["payout_numerators"] == ["1", "0", str(2**255)] and got[0]["outcome_slot_count"] == 3
    assert got[1]["payout_numerators"] is None and got[2]["payout_numerators"] == []
    o = got[3]
    assert (o["side"], o["token_id"], o["maker_amount_raw"], o["taker_amount_raw"], o["fee_raw"], o["builder"], o["metadata"]) == (1, str(2**200), "5", "6", "7", word(8), word(9))
    assert got[4]["amount_raw"] is None and got[4]["from_"] == "0x" + "0" * 38 + "ab"


def test_distance_of_shares(spark):
    frame = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "v double")
    a, b = [1, 1, 2, 5, 9, 40], [2, 3, 3, 1000]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)
    for buckets in (1, 3, 10_000):
        assert R.ks_distance(frame(a), frame(b), "v", buckets).first()["ks"] == pytest.approx(want)
    assert R.ks_distance(frame([4, 4]), frame([4]), "v").first()["ks"] == pytest.approx(0)
    assert R.ks_distance(frame([]), frame(b), "v").first()["ks"] is None


def test_streams(spark, tmp_path):
    from tapeworks.streaming import streams as T

    rows = [("a", i * 20 * NS, float(i), f"b{i % 3}", i % 3) for i in range(9)]
    spark.createDataFrame(rows, "symbol string, t_ns long, mid double, block_hash string, log_index int").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: T.with_event_time(T.stream_feed(spark, str(tmp_path / "in"), "symbol string, t_ns long, mid double, block_hash string, log_index int"))
    bars = T.run_once(T.stream_bars(src()), "bars", "complete").orderBy("start").collect()
    assert [(r["close"], r["n"]) for r in bars] == [(2.0, 3), (5.0, 3), (8.0, 3)]
    assert T.run_once(T.dedup_chain(src()), "dedup").count() == 3


def test_slots(spark):
    g = [r["slug"] for r in S.slot_grid(spark, ["BTC"], {"5m": 300}, 601, 900).orderBy("slot").collect()]
    assert g == ["btc-updown-5m-600", "btc-updown-5m-900", "btc-updown-5m-1200"]
    now = 1716732000  # 2024-05-26 14:00 UTC
    hourly = [r["slug"] for r in S.lookahead_slots(spark, ["BTC"], now, 1).where("horizon = '1h'").orderBy("slot").collect()]
    assert hourly == ["btc-up-or-down-may-26-10am-et", "btc-up-or-down-may-26-11am-et"]


def test_keyed_state(spark, tmp_path):
    from tapeworks.streaming import streams as T

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "token_id string, block_number long, log_index int, signed_size double, price double"
    for k, rows in enumerate([[("a", 1, 0, 5.0, 0.5), ("b", 1, 1, 2.0, 0.4)], [("a", 2, 0, -7.0, 0.6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            T.run_to_table(T.stream_inventory(T.stream_feed(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = T.run_to_table(T.stream_inventory(T.stream_feed(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r["token_id"], r["block_number"], r["position"]) for r in got.collect()) == [("a", 1, 5.0), ("a", 2, -2.0), ("b", 1, 2.0)]


def test_whole_tables_of_quotes_and_fills(spark, sf):
    from tapeworks.plans.registry import QUERIES

    ticks = spark.read.parquet(f"{sf}/events.parquet").count()
    assert QUERIES["l15_quote_features"](spark, sf).count() == ticks
    parts = [QUERIES["f5_quote_patterns_by_outcome"](spark, sf).where(f"outcome = '{x}'") for x in ("Up", "Down")]
    assert parts[0].count() == parts[1].count() > 0 and all(p.select("pattern").distinct().count() > 1 for p in parts)
    traded = QUERIES["e17_selection_rate_by_asset"](spark, sf).groupBy().sum("traded").first()[0]
    lines, parts = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part"))
    markets = parts.selectExpr("p_partkey div 2 as m").distinct()
    assert traded == lines.selectExpr("l_partkey div 2 as m").distinct().join(markets, "m", "left_semi").count()


def test_fair_values_of_all_options(spark, sf):
    from tapeworks.plans.registry import QUERIES
    from tapeworks.plans.stats_queries import options

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = options(spark, sf).collect()
    d = [math.log(r["spot"] / r["strike"]) / (r["sigma"] * math.sqrt(r["tau"])) for r in rows]
    got = QUERIES["k3_fair_value_up_all"](spark, sf).collect()
    assert len(got) == len(rows) and any(abs(x) >= 4 for x in d)
    want = sorted((*(r[k] for k in keys), math.erfc(-x / math.sqrt(2)) / 2) for r, x in zip(rows, d))
    for r, w in zip(sorted(got), want):
        assert r[:4] == w[:4] and r["fair"] == pytest.approx(w[4], rel=1e-6) and (r["reason"] == "clipped") == (r["fair"] in (0, 1))
    for name in ("k5_implied_sigma_all", "k11_implied_spot_all"):
        reasons = {r["reason"]: r["n"] for r in QUERIES[name](spark, sf).collect()}
        assert sum(reasons.values()) == len(rows) and set(reasons) <= {"ok", "clipped", "imprecise"}
        low = sum(-36 < x < 4 for x in d)
        assert reasons["ok"] >= low


def test_chain_words_at_the_bounds_of_their_ways(spark):
    """Numbers on both sides of each way of reading them, in any case of the hex; a contract listed twice; no array function for single words."""
    values = [0, 2**63, 2**64 - 1, 2**64, 2**124 - 1, 2**124, 2**256 - 1]
    topic = {v: k for k, v in S.TOPICS.items()}
    rows = [(i, [p + topic["FeeCharged"].upper(), "0x" + f"{0xAB:064X}"], p + f"{v:064X}", S.EXCHANGES[0]) for i, v in enumerate(values) for p in (["0x", ""][i % 2],)]
    logs = spark.createDataFrame(rows, "log_index int, topics array<string>, data string, address string").selectExpr("*", "1L as block_number", "'0x1' as tx_hash")
    d = S.decode_chain_logs(logs, {"FeeCharged": [S.EXCHANGES[0], S.EXCHANGES[0].upper().replace("0X", "0x")]})
    assert [(r["amount_raw"], r["receiver"], r["address"]) for r in d.orderBy("log_index").collect()] == [(str(v), "0x" + "0" * 38 + "ab", S.EXCHANGES[0]) for v in values]
    assert S.decode_chain_logs(logs, {}).count() == 0
    plan = d.drop("payout_numerators")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(" not in plan and "transform(CASE" not in plan
