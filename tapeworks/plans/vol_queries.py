"""Queries over ticks, bars and volatility estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import volatility as Y
from . import views as V
from .registry import register

HOUR = 3600
ANN = "sqrt(365.25 * 24)"


def bars(spark, sf):
    return Y.bars(V.ticks(spark, sf), HOUR)


def rets(spark, sf):
    return Y.log_returns(bars(spark, sf))


@register("f9_bars", "SELECT symbol, bar, open, high, low, close, t_ns, n_ticks FROM bars", "open high low close")
def q_bars(spark, sf):
    return bars(spark, sf)


@register("f8_log_returns", "SELECT symbol, t_ns, ln(mid) - ln(lag(mid) OVER (PARTITION BY symbol ORDER BY t_ns)) AS r FROM ticks", "r")
def q_returns(spark, sf):
    return Y.log_returns(V.ticks(spark, sf), "mid", "t_ns").select("symbol", "t_ns", "r")


@register("j1_rv_rows", f"SELECT symbol, bar, CASE WHEN count(r) OVER w < 2 THEN 0 ELSE sqrt(avg(r * r) OVER w) * {ANN} END AS rv FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING)", "rv")
def q_rv(spark, sf):
    return Y.rv_rows(rets(spark, sf), 24, HOUR).select("symbol", "bar", "rv")


@register("j1_rv_range", f"SELECT symbol, bar, CASE WHEN count(r) OVER w < 2 THEN 0 ELSE sqrt(avg(r * r) OVER w) * {ANN} END AS rv FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar RANGE 11 PRECEDING)", "rv")
def q_rv_range(spark, sf):
    return Y.rv_range(rets(spark, sf), 12, HOUR).select("symbol", "bar", "rv")


@register("j2_rv_ticks", """WITH r AS (SELECT *, ln(mid) - ln(lag(mid) OVER (PARTITION BY symbol ORDER BY t_ns)) AS r FROM ticks), g AS (SELECT symbol, t_ns, avg(r * r) OVER w AS m, count(r) OVER w AS n, (max(t_ns) OVER w - min(t_ns) OVER w) / greatest(count(*) OVER w - 1, 1) / 1e9 AS gap FROM r WINDOW w AS (PARTITION BY symbol ORDER BY t_ns ROWS 50 PRECEDING))
    SELECT symbol, t_ns, CASE WHEN n >= 2 AND gap > 0 THEN sqrt(m / gap * 31557600) ELSE 0 END AS rv_ticks FROM g""", "rv_ticks")
def q_rv_ticks(spark, sf):
    return Y.rv_ticks(Y.log_returns(V.ticks(spark, sf), "mid", "t_ns"), 50).select("symbol", "t_ns", "rv_ticks")


@register("j3_rv_bars", f"SELECT symbol, bar, CASE WHEN count(r) OVER w >= 30 THEN stddev_pop(r) OVER w * {ANN} END AS rv_bars FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 60 PRECEDING)", "rv_bars")
def q_rv_bars(spark, sf):
    return Y.rv_bars(rets(spark, sf), 60, 30, HOUR).select("symbol", "bar", "rv_bars")


@register("j4_j6_ewma_series", """WITH n AS (SELECT symbol, bar, r, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM rets WHERE r IS NOT NULL),
    a AS (SELECT symbol, bar, i, list(r) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS xs FROM n)
    SELECT symbol, bar, list_reduce(list_prepend(xs[1] * xs[1], xs), lambda h, x: 0.94 * h + (1 - 0.94) * x * x) AS h FROM a""", "h", 9)
def q_ewma(spark, sf):
    return Y.ewma_series(rets(spark, sf), 0.94, 240).select("symbol", "bar", "h")


@register("j5_ewma_trailing", f"""WITH l AS (SELECT symbol, bar, list(r) FILTER (WHERE r IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar ROWS 47 PRECEDING) AS xs FROM rets)
    SELECT symbol, bar, CASE WHEN len(coalesce(xs, [])) >= 2 THEN sqrt(list_reduce(list_prepend(list_var_pop(xs[1:10]), xs), lambda h, x: 0.94 * h + x * x * (1 - 0.94))) * {ANN} ELSE 0 END AS ewma FROM l""", "ewma")
def q_ewma_trailing(spark, sf):
    return Y.ewma_trailing(rets(spark, sf), 0.94, 48, 10, HOUR).select("symbol", "bar", "ewma")


@register("j7_parkinson", f"SELECT symbol, bar, CASE WHEN count(*) OVER w >= 5 THEN sqrt(avg(power(ln(high / low), 2)) OVER w / (4 * ln(2))) * {ANN} END AS parkinson FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING)", "parkinson")
def q_parkinson(spark, sf):
    return Y.parkinson(bars(spark, sf), 24, 5, HOUR).select("symbol", "bar", "parkinson")


@register("j8_garman_klass", f"SELECT symbol, bar, CASE WHEN count(*) OVER w >= 5 THEN sqrt(greatest(avg(0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2)) OVER w, 0)) * {ANN} END AS garman_klass FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 59 PRECEDING)", "garman_klass")
def q_gk(spark, sf):
    return Y.garman_klass(bars(spark, sf), 60, 5, HOUR).select("symbol", "bar", "garman_klass")


@register("j9_seasonal", f"""WITH v AS (SELECT symbol, bar, CASE WHEN count(r) OVER w < 2 THEN 0 ELSE sqrt(avg(r * r) OVER w) * {ANN} END AS rv FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING)),
    m AS (SELECT symbol, (bar // 60) % 24 AS hour, quantile_cont(rv, 0.5) AS med FROM v GROUP BY 1, 2), f AS (SELECT symbol, hour, med / avg(med) OVER (PARTITION BY symbol) AS factor FROM m)
    SELECT v.symbol, bar, rv * coalesce(factor, 1) AS seasonal FROM v LEFT JOIN f ON v.symbol = f.symbol AND (v.bar // 60) % 24 = f.hour""", "seasonal")
def q_seasonal(spark, sf):
    d = Y.rv_rows(rets(spark, sf), 24, HOUR)
    return Y.seasonal(d, Y.hour_factors(d, "rv"), "rv").select("symbol", "bar", "seasonal")


@register("j10_intensity", f"""WITH v AS (SELECT symbol, bar, n_ticks, CASE WHEN count(r) OVER w < 2 THEN 0 ELSE sqrt(avg(r * r) OVER w) * {ANN} END AS rv FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING)), m AS (SELECT symbol, quantile_cont(n_ticks, 0.5) AS med FROM v GROUP BY 1)
    SELECT v.symbol, bar, rv * sqrt(greatest(n_ticks, 1) / greatest(med, 1.0)) AS intensity FROM v JOIN m ON v.symbol = m.symbol""", "intensity")
def q_intensity(spark, sf):
    return Y.intensity(Y.rv_rows(rets(spark, sf), 24, HOUR), "rv").select("symbol", "bar", "intensity")


@register("j12_f12_pct_rank", """WITH l AS (SELECT symbol, bar, close, list(close) OVER (PARTITION BY symbol ORDER BY bar ROWS 99 PRECEDING) AS xs FROM bars)
    SELECT symbol, bar, CASE WHEN len(xs) >= 30 THEN len(list_filter(xs, lambda x: x <= close)) / len(xs) ELSE 0.5 END AS pct_rank FROM l""", "pct_rank")
def q_rank(spark, sf):
    return Y.pct_rank_trailing(bars(spark, sf), "close", 100).select("symbol", "bar", "pct_rank")


@register("j11_garch11")
def q_garch(spark, sf):
    return Y.garch11(rets(spark, sf), 240, 30)


@register("f10_f16_ret_over", """WITH p AS (SELECT event_id, t_ns, symbol, mid FROM ticks), s AS (SELECT p.*, a.mid AS m1, b.mid AS m2 FROM (SELECT p.*, t_ns - 3600000000000 AS t1, t_ns - 18000000000000 AS t2 FROM p) p ASOF LEFT JOIN ticks a ON p.symbol = a.symbol AND p.t1 >= a.t_ns ASOF LEFT JOIN ticks b ON p.symbol = b.symbol AND p.t2 >= b.t_ns)
    SELECT event_id, coalesce(mid / m1 - 1, 0) AS ret_3600s, coalesce(mid / m2 - 1, 0) AS ret_18000s FROM s""", "ret_3600s ret_18000s")
def q_ret_over(spark, sf):
    t = V.ticks(spark, sf)
    return Y.ret_over(t.select("event_id", "t_ns", "symbol"), t, [3600, 18000], 24 * Y.NS * HOUR).select("event_id", "ret_3600s", "ret_18000s")


@register("f11_cross_asset_ret", """WITH l AS (SELECT * FROM ticks WHERE symbol = 'click'), p AS (SELECT event_id, t_ns, t_ns - 3600000000000 AS t1 FROM ticks)
    SELECT p.event_id, coalesce(a.mid / b.mid - 1, 0) AS lead_ret_3600s FROM p ASOF LEFT JOIN l a ON p.t_ns >= a.t_ns ASOF LEFT JOIN l b ON p.t1 >= b.t_ns""", "lead_ret_3600s")
def q_cross(spark, sf):
    t = V.ticks(spark, sf)
    return Y.cross_asset_ret(t.select("event_id", "t_ns", "symbol"), t, "click", 3600, 24 * Y.NS * HOUR).select("event_id", "lead_ret_3600s")


@register("f13_rolling_hours", """WITH s AS (SELECT t_ns // 3600000000000 AS slot, sum(size * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) AS net FROM book_fills GROUP BY 1), a AS (SELECT unnest(range((SELECT min(slot) FROM s), (SELECT max(slot) FROM s) + 1)) AS slot),
    d AS (SELECT a.slot, coalesce(net, 0) AS net FROM a LEFT JOIN s ON a.slot = s.slot), r AS (SELECT *, sum(net) OVER (ORDER BY slot RANGE 54 PRECEDING) AS rolling FROM d)
    SELECT slot, net, rolling, (rolling - avg(rolling) OVER ()) / stddev_pop(rolling) OVER () AS z FROM r""", "net rolling z")
def q_rolling(spark, sf):
    f = V.book_fills(spark, sf)
    s = f.groupBy(F.floor(F.col("t_ns") / (HOUR * Y.NS)).cast("bigint").alias("slot")).agg(F.sum(F.col("size") * F.when(F.col("side") == "BUY", 1).otherwise(-1)).alias("net"))
    return Y.rolling_hours(s, 55).drop("pctile")


@register("f14_lag_autocorr", """WITH k AS (SELECT unnest(range(1, 11)) AS lag), n AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM rets)
    SELECT a.symbol, k.lag, corr(a.r, b.r) AS acf, count(*) AS n, abs(corr(a.r, b.r)) > 1.96 / sqrt(count(*)) AS significant FROM k, n a JOIN n b ON a.symbol = b.symbol AND a.i = b.i + k.lag WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2""", "acf")
def q_acf(spark, sf):
    return Y.lag_autocorr(rets(spark, sf), "r", 10, ["symbol"], ["bar"])


@register("f15_session_split", """WITH g AS (SELECT *, CASE WHEN t_ns - lag(t_ns) OVER (PARTITION BY symbol ORDER BY t_ns) > 1800000000000 THEN 1 WHEN lag(t_ns) OVER (PARTITION BY symbol ORDER BY t_ns) IS NULL THEN 1 ELSE 0 END AS s FROM ticks), r AS (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY t_ns ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT symbol AS service, CAST(session AS BIGINT) AS session, min(t_ns) AS start_ns, max(t_ns) AS end_ns, count(*) AS n FROM r GROUP BY 1, 2""")
def q_sessions(spark, sf):
    return Y.session_split(V.ticks(spark, sf).withColumnRenamed("symbol", "service"), 1800)


@register("f17_taker_flow", "SELECT event_id, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) OVER (PARTITION BY token_id ORDER BY t_ns RANGE BETWEEN 86400000000000 PRECEDING AND CURRENT ROW) AS flow FROM book_fills", "flow")
def q_flow(spark, sf):
    f = V.book_fills(spark, sf).withColumn("signed_size", F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size")))
    return Y.taker_flow(f, 86400).select("event_id", "flow")


def pairs(spark, sf):
    """Bars of every symbol beside those of click."""
    b = rets(spark, sf)
    return b.join(b.where("symbol = 'click'").select("bar", F.col("close").alias("lead"), F.col("r").alias("lead_r")), "bar")


PAIRS = "(SELECT b.*, c.close AS lead, c.r AS lead_r FROM rets b JOIN rets c ON b.bar = c.bar AND c.symbol = 'click')"


@register("e27_corr_by", f"SELECT symbol, corr(close, lead) AS corr, count(*) AS n FROM {PAIRS} GROUP BY 1 HAVING count(*) >= 5", "corr")
def q_corr(spark, sf):
    return Y.corr_by(pairs(spark, sf), ["symbol"], "close", "lead")


@register("e28_corr_by_bucket", f"""WITH b AS (SELECT symbol, bar // 360 AS bucket, corr(close, lead) AS c, count(*) AS n FROM {PAIRS} WHERE symbol <> 'click' GROUP BY 1, 2)
    SELECT symbol, avg(c) AS mean, stddev_pop(c) AS std, count(*) AS buckets, stddev_pop(c) / abs(avg(c)) AS cv FROM b WHERE n >= 5 AND c IS NOT NULL AND NOT isnan(c) GROUP BY 1""", "mean std cv")
def q_corr_bucket(spark, sf):
    return Y.corr_by_bucket(pairs(spark, sf).where("symbol <> 'click'"), "close", "lead")


@register("e29_variance_ratio", f"SELECT symbol, var_pop(close - lead) / var_pop(lead) AS ratio FROM {PAIRS} GROUP BY 1", "ratio")
def q_ratio(spark, sf):
    return Y.variance_ratio(pairs(spark, sf), "close", "lead", "symbol")


@register("e24_clock_offset_by_symbol", """WITH f AS (SELECT event_id, ['view','error','click','signup','purchase'][event_id % 5 + 1] AS symbol, t_ns FROM book_fills), b AS (SELECT f.*, t.t_ns AS bt FROM f ASOF LEFT JOIN ticks t ON f.symbol = t.symbol AND f.t_ns >= t.t_ns), n AS (SELECT b.*, t.t_ns AS ft FROM b ASOF LEFT JOIN ticks t ON b.symbol = t.symbol AND b.t_ns <= t.t_ns)
    SELECT symbol, count(*) AS n, quantile_cont(least(coalesce(t_ns - bt, 9e18), coalesce(ft - t_ns, 9e18)) / 1e6, 0.5) AS p50_ms, quantile_cont(least(coalesce(t_ns - bt, 9e18), coalesce(ft - t_ns, 9e18)) / 1e6, 0.5) < 100 AS passed FROM n GROUP BY 1""", "p50_ms", 3)
def q_offset(spark, sf):
    from ..operators.ordered import asof_nearest
    from .level_queries import probes

    j = asof_nearest(probes(spark, sf), V.ticks(spark, sf), "t_ns", ["symbol"], {"tick_ns": "t_ns"})
    g = j.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile(F.abs(F.col("t_ns") - F.col("tick_ns")) / 1e6, 0.5).alias("p50_ms"))
    return g.withColumn("passed", F.col("p50_ms") < 100)
