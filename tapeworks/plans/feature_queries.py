"""Queries over strikes, quote features and implied volatility at post time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing as P
from ..operators import features as Q
from . import views as V
from .level_queries import levels
from .registry import register
from .stats_queries import OPT, PHI, PPF, TAIL, options, returned

NS = 1_000_000_000
DAY = 86400 * NS


@register("d4_with_strike", """WITH m AS (SELECT symbol, t_ns // 86400000000000 * 86400000000000 AS start_ns FROM ticks GROUP BY 1, 2), b AS (SELECT m.*, t.t_ns AS bt, t.mid AS bm FROM m ASOF LEFT JOIN ticks t ON m.symbol = t.symbol AND m.start_ns >= t.t_ns),
    n AS (SELECT b.*, t.t_ns AS ft, t.mid AS fm FROM b ASOF LEFT JOIN ticks t ON b.symbol = t.symbol AND b.start_ns <= t.t_ns) SELECT symbol, start_ns, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR start_ns - bt <= ft - start_ns) THEN bm ELSE fm END AS strike FROM n""", "strike")
def strike(spark, sf):
    t = V.ticks(spark, sf)
    m = t.select("symbol", (F.floor(F.col("t_ns") / DAY).cast("bigint") * DAY).alias("start_ns")).distinct()
    return Q.with_strike(m, t)


# Of several ticks of a symbol at one time, the highest.
LAST = "SELECT symbol, t_ns, max(mid) AS mid FROM ticks GROUP BY 1, 2"


@register("k7_implied_sigma_at_post", f"""WITH o AS (SELECT l.token_id, l.t_recv_ns FROM levels l WHERE classification = 'new_order' AND EXISTS (SELECT 1 FROM book_fills f WHERE f.token_id = l.token_id AND f.price = l.price AND f.side = l.side)),
    i AS (SELECT token_id, min(t_ns) AS t, CAST(min({{'t': t_ns, 'p': CAST(price AS DOUBLE)}}).p AS DOUBLE) AS price FROM book_fills GROUP BY 1),
    q AS (SELECT i.token_id, i.price, min(o.t_recv_ns) AS t_ns, (i.t - min(o.t_recv_ns)) / 1e9 AS lag_s FROM i JOIN o ON i.token_id = o.token_id AND o.t_recv_ns < i.t AND o.t_recv_ns >= i.t - 86400000000000 GROUP BY i.token_id, i.price, i.t),
    k AS ({LAST}), c AS (SELECT * FROM k WHERE symbol = 'click'), b AS (SELECT q.*, c.t_ns AS bt, c.mid AS bm FROM q ASOF LEFT JOIN c ON q.t_ns >= c.t_ns), n AS (SELECT b.*, c.t_ns AS ft, c.mid AS fm FROM b ASOF LEFT JOIN c ON b.t_ns <= c.t_ns),
    s AS (SELECT token_id, t_ns, lag_s, price, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t_ns - bt <= ft - t_ns) THEN bm ELSE fm END AS spot FROM n),
    r AS (SELECT *, CASE WHEN spot IS NULL THEN 'no_spot' WHEN price < 0.02 OR price > 0.98 THEN 'price_edge' WHEN abs(price - 0.5) < 0.02 THEN 'price_atm' WHEN abs(ln(120 / spot)) < 1e-4 THEN 'spot_atm' ELSE 'ok' END AS why, CASE WHEN price BETWEEN 0.02 AND 0.98 AND abs(price - 0.5) >= 0.02 THEN 1 - price ELSE 0.25 END AS p FROM s),
    v AS (SELECT *, ln(120 / spot) / (sqrt((3600 + lag_s) / 31557600) * z5) AS x FROM ({PPF.format(table="r")}))
    SELECT token_id, t_ns, lag_s, spot, CASE WHEN why = 'ok' AND x > 0 AND x <= 15 THEN x END AS sigma, CASE WHEN why = 'ok' AND (x <= 0 OR x > 15) THEN 'sigma_range' ELSE why END AS reason FROM v""", "lag_s spot sigma", 6)
def at_post(spark, sf):
    """Each token's volatility as its first fill's price implies it at the time its quote was posted, or the reason why there is none."""
    f = V.book_fills(spark, sf).select("token_id", F.col("price").cast("double").alias("price"), F.col("price").alias("level_price"), "side", "t_ns", F.lit("click").alias("symbol"), F.lit(120.0).alias("strike"), F.lit(3600.0).alias("tte_s"))
    return Q.implied_sigma_at_post(f, levels(spark, sf), V.ticks(spark, sf), DAY)


@register("l15_quote_features", f"""WITH k AS ({LAST}), c AS (SELECT * FROM k WHERE symbol = 'click'), q AS (SELECT event_id AS quote_id, t_ns, symbol, t_ns - 60000000000 AS t1, t_ns - 3600000000000 AS t2 FROM ticks),
    j AS (SELECT q.*, k.mid AS spot, a.mid AS m1, b.mid AS m2, l.mid AS l0, o.mid AS l2 FROM q ASOF LEFT JOIN k ON q.symbol = k.symbol AND q.t_ns >= k.t_ns ASOF LEFT JOIN k a ON q.symbol = a.symbol AND q.t1 >= a.t_ns ASOF LEFT JOIN k b ON q.symbol = b.symbol AND q.t2 >= b.t_ns ASOF LEFT JOIN c l ON q.t_ns >= l.t_ns ASOF LEFT JOIN c o ON q.t2 >= o.t_ns),
    r AS (SELECT *, coalesce(spot / m1 - 1, 0) AS ret_60s, coalesce(spot / m2 - 1, 0) AS ret_3600s, coalesce(l0 / l2 - 1, 0) AS lead_ret_3600s, CAST(3600 AS DOUBLE) / 31557600 AS tau FROM j), d AS (SELECT *, ln(spot / 120) / (0.5 * sqrt(tau)) AS d FROM r)
    SELECT quote_id, t_ns, symbol, CAST(120 AS DOUBLE) AS strike, CAST(3600 AS DOUBLE) AS tte_s, CAST(1 AS DOUBLE) AS n, ret_60s, ret_3600s, lead_ret_3600s, spot, abs(ret_60s) AS abs_ret_60s, abs(ret_3600s) AS abs_ret_3600s,
    CASE WHEN abs(d) < 4 THEN {PHI.format(x="d")} WHEN d > 0 THEN 1 - {TAIL.format(x="d")} ELSE {TAIL.format(x="(-d)")} END AS fair, CAST(t_ns // 3600000000000 % 24 AS INTEGER) AS hour, CAST((t_ns // 86400000000000 + 3) % 7 AS INTEGER) AS dow,
    ln(tau) AS log_tau, sqrt(tau) AS sqrt_tau, 0.5 * sqrt(tau) AS sigma_sqrt_tau, abs(ln(spot / 120)) AS abs_log_move, ln(CAST(120 AS DOUBLE)) AS log_strike, CAST(0 AS DOUBLE) AS log1p_lag, ln(CAST(2 AS DOUBLE)) AS log1p_n FROM d""",
    "ret_60s ret_3600s lead_ret_3600s spot abs_ret_60s abs_ret_3600s fair log_tau sqrt_tau sigma_sqrt_tau abs_log_move log_strike log1p_n", 7)
def features(spark, sf):
    """Every tick as a quote, with the returns, fair value, distances and time parts of its moment."""
    t = V.ticks(spark, sf)
    q = t.select(F.col("event_id").alias("quote_id"), "t_ns", "symbol", F.lit(120.0).alias("strike"), F.lit(3600.0).alias("tte_s"), F.lit(1.0).alias("n"))
    return Q.quote_features(q, t, "click", 0.5, (60, 3600))


@register("k11_implied_spot", f"SELECT count(*) AS n, count(*) AS back FROM {OPT} WHERE abs(ln(strike / spot) / (sigma * sqrt(tau))) < 4")
def implied_spot(spark, sf):
    """The spot comes back from the fair price it made."""
    o = options(spark, sf).where("abs(ln(strike / spot) / (sigma * sqrt(tau))) < 4")
    fair = P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma"))
    o = o.withColumn("fair", fair).withColumn("s", P.implied_spot(F.col("strike"), F.col("fair"), F.col("tau"), F.col("sigma")))
    return o.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("s") / F.col("spot") - 1) < 1e-6).alias("back"))


@register("k11_implied_spot_all")
def implied_spot_all(spark, sf):
    """All rows, by what becomes of the spot that the fair price gives back."""
    fair = P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma"))
    o = options(spark, sf).withColumn("fair", fair).withColumn("s", P.implied_spot(F.col("strike"), F.col("fair"), F.col("tau"), F.col("sigma")))
    return returned(o, F.abs(F.col("s") / F.col("spot") - 1) < 1e-6)


@register("k11_implied_spot_values", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN d < 5 THEN spot END AS implied, CASE WHEN d < 5 THEN 0.0 END AS basis FROM (SELECT *, -ln(strike / spot) / (sigma * sqrt(tau)) AS d FROM {OPT})", "implied basis", 5)
def implied_spot_values(spark, sf):
    """Every row's spot as its fair price gives it back, and how far that is from the spot; null where the price is too close to 1 for a double."""
    d = -F.log(F.col("strike") / F.col("spot")) / (F.col("sigma") * F.sqrt("tau"))
    fair = P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma"))
    o = options(spark, sf).withColumn("d", d).withColumn("fair", fair).withColumn("implied", F.when(F.col("d") < 5, P.implied_spot(F.col("strike"), F.col("fair"), F.col("tau"), F.col("sigma"))))
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "implied", (F.col("implied") / F.col("spot") - 1).alias("basis"))


@register("l14_open_volatility", """WITH b AS (SELECT asset_symbol AS symbol, t_block_ns // 86400000000000 AS bar, max({'t': t_block_ns, 'm': price}).m AS close, max(t_block_ns) AS t_ns FROM fills GROUP BY 1, 2), r AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY bar)) AS r FROM b),
    n AS (SELECT *, list(r) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS xs, CASE WHEN count(r) OVER w5 < 2 THEN 0 ELSE sqrt(avg(r * r) OVER w5 * 365.25) END AS rv_5, CASE WHEN count(r) OVER w30 < 2 THEN 0 ELSE sqrt(avg(r * r) OVER w30 * 365.25) END AS rv_30 FROM r WHERE r IS NOT NULL WINDOW w5 AS (PARTITION BY symbol ORDER BY bar ROWS 4 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY bar ROWS 29 PRECEDING)),
    h AS (SELECT *, list_reduce(list_prepend(xs[1] * xs[1], xs), lambda h, x: 0.94 * h + (1 - 0.94) * x * x) AS ewma_var FROM n), p AS (SELECT *, list(ewma_var) OVER (PARTITION BY symbol ORDER BY bar ROWS 29 PRECEDING) AS hs FROM h),
    q AS (SELECT symbol, t_ns, ewma_var, rv_5, rv_30, CASE WHEN len(hs) < 10 THEN 0.5 ELSE len(list_filter(hs, lambda x: x <= ewma_var)) / len(hs) END AS ewma_rank FROM p)
    SELECT m.o_orderkey, q.ewma_var, q.rv_5, q.rv_30, q.ewma_rank FROM market_slots m ASOF LEFT JOIN q ON m.asset_symbol = q.symbol AND m.start_ns >= q.t_ns""", "ewma_var rv_5 rv_30", 6)
def open_volatility(spark, sf):
    """Markets with the volatility of their asset's daily bars of fill prices at their start. The rank is a share of values that may differ in
    the last digit, so it is compared where no two are that close."""
    from ..operators import volatility as Y

    ticks = V.fills(spark, sf).select(F.col("asset_symbol").alias("symbol"), F.col("t_block_ns").alias("t_ns"), F.col("price").alias("mid"))
    m = V.market_slots(spark, sf).select("o_orderkey", F.col("asset_symbol").alias("symbol"), "start_ns")
    return Q.open_volatility(m, Y.bars(ticks, 86400), 86400).select("o_orderkey", "ewma_var", "rv_5", "rv_30", "ewma_rank")
