"""Queries over fills, positions and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as M
from ..operators import fills as X
from ..operators import ordered
from ..operators import regress as R
from . import views as V
from .registry import register


def canon(spark, sf):
    return X.with_canonical(V.fills(spark, sf))


def marked(spark, sf):
    return X.with_mtm(canon(spark, sf), V.resolved(spark, sf))


PX = "CAST(20000 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 960001 AS DOUBLE) / 1000000"


@register(
    "c5_c10_build_fills",
    f"""WITH e AS (SELECT *, {PX} AS px FROM lineitem WHERE (l_suppkey % 5 = 0 OR (l_suppkey + 2) % 5 = 0) AND l_suppkey % 4 <> 3)
    SELECT CAST(l_partkey AS VARCHAR) AS token_id, m.market, m.asset_symbol, m.horizon, m.outcome_side, l_orderkey AS block_number, l_linenumber AS log_index, 'x' || l_orderkey AS tx_hash,
      epoch_us(l_shipdate) * 1000 + (l_orderkey % 86400) * 1000000000 AS t_block_ns, epoch_us(l_shipdate) * 1000 + (l_orderkey % 86400 + (l_linenumber - 2) * 4) * 1000000000 AS t_recv_ns,
      abs((l_linenumber - 2) * 4) > 10 AS is_backfilled, l_suppkey % 5 = 0 AS is_maker, CASE WHEN (l_partkey + l_linenumber) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, round(px, 6) AS price, l_quantity AS size,
      CASE WHEN l_suppkey % 5 = 0 THEN 0.014 * least(px, 1 - px) * l_quantity ELSE 0 END AS maker_rebate, m.end_date_unix - (epoch_us(l_shipdate) / 1000000.0 + l_orderkey % 86400) AS time_to_expiry_s
    FROM e LEFT JOIN markets m ON CAST(l_partkey AS VARCHAR) = m.token_id""",
    "price maker_rebate time_to_expiry_s",
    9,
)
def build_fills(spark, sf):
    return X.build_fills(V.chain_events(spark, sf), V.markets(spark, sf), "acct0", ["ex0", "ex1", "ex2"])


@register("d1_with_block_time", "SELECT l_orderkey AS block_number, l_linenumber AS log_index, l_partkey AS part, b.t_block_ns FROM lineitem LEFT JOIN (SELECT o_orderkey AS block_number, epoch_us(o_orderdate) * 1000 AS t_block_ns FROM orders) b ON l_orderkey = b.block_number")
def block_time(spark, sf):
    blocks = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("block_number"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("t_block_ns"))
    rows = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block_number"), F.col("l_linenumber").alias("log_index"), F.col("l_partkey").alias("part"))
    return X.with_block_time(rows, blocks)


@register("d2_with_ws_time", """SELECT f.token_id, f.block_number, f.log_index, f.size, coalesce(p.t, f.t_block_ns) AS t_fill_ns, CASE WHEN p.t IS NOT NULL THEN 'print' ELSE 'block' END AS timing
    FROM fills f LEFT JOIN (SELECT 'x' || event_id AS tx_hash, min(epoch_us(ts) * 1000) AS t FROM events GROUP BY 1) p ON f.tx_hash = p.tx_hash""")
def ws_time(spark, sf):
    prints = V.table(spark, sf, "events").select(F.concat(F.lit("x"), "event_id").alias("tx_hash"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t_recv_ns"))
    return X.with_ws_time(V.fills(spark, sf), prints).select("token_id", "block_number", "log_index", "size", "t_fill_ns", "timing")


@register("c11_c16_canonical", """SELECT token_id, block_number, log_index, size, canonical_sign, up_price, up_price - 0.5 AS atm_displacement, abs(up_price - 0.5) AS otm_cushion, -(up_price - 0.5) * canonical_sign AS adverse_selection,
    CASE WHEN up_price > 0.5 THEN 'Down' WHEN up_price < 0.5 THEN 'Up' ELSE 'ATM' END AS rebate_favoured, (CASE WHEN up_price > 0.5 THEN 'Down' WHEN up_price < 0.5 THEN 'Up' ELSE 'ATM' END) = outcome_side AS rebate_aligned,
    maker_rebate / greatest(price * size, 1e-9) AS rebate_pct FROM canon""", "up_price atm_displacement otm_cushion adverse_selection rebate_pct")
def canonical(spark, sf):
    return canon(spark, sf).withColumn("rebate_pct", M.rebate_pct(F.col("maker_rebate"), F.col("price"), F.col("size"))).select("token_id", "block_number", "log_index", "size", "canonical_sign", "up_price", "atm_displacement", "otm_cushion", "adverse_selection", "rebate_favoured", "rebate_aligned", "rebate_pct")


@register("c17_c18_override_conform", "SELECT f.token_id, coalesce(m.horizon, f.horizon) AS horizon, CAST(NULL AS VARCHAR) AS note, f.size FROM fills f LEFT JOIN (SELECT token_id, upper(horizon) AS horizon FROM markets WHERE CAST(token_id AS INT) % 3 = 0) m ON f.token_id = m.token_id")
def override(spark, sf):
    better = V.markets(spark, sf).where(F.col("token_id").cast("int") % 3 == 0).select("token_id", F.upper("horizon").alias("__h"))
    j = V.fills(spark, sf).join(better, "token_id", "left").withColumn("horizon", F.coalesce("__h", "horizon"))
    return X.conform_columns(j, ["token_id", "horizon", "note", "size"])


@register("c19_mtm_binary", "SELECT token_id, block_number, log_index, size, up_wins, mtm FROM marked", "mtm")
def mtm(spark, sf):
    return marked(spark, sf).select("token_id", "block_number", "log_index", "size", "up_wins", "mtm")


@register("c22_win_flags", """SELECT asset_symbol, count_if(canonical_sign = 1 AND up_wins = 1) AS long_won, count_if(canonical_sign = 1 AND up_wins = 0) AS long_lost, count_if(canonical_sign = -1 AND up_wins = 0) AS short_won, count_if(canonical_sign = -1 AND up_wins = 1) AS short_lost FROM marked GROUP BY 1""")
def win_flags(spark, sf):
    flags = M.win_flags(F.col("canonical_sign"), F.col("up_wins"))
    return marked(spark, sf).groupBy("asset_symbol").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


@register("c23_sign_audit", "SELECT count(*) AS n, avg(CASE WHEN abs(price * size - (1 - up_wins) * size - mtm) < 1e-6 THEN 1 ELSE 0 END) AS match_share FROM marked WHERE side = 'SELL' AND outcome_side = 'Down' AND up_wins IS NOT NULL", "match_share")
def sign_audit(spark, sf):
    return X.sign_audit(marked(spark, sf))


@register("c24_c25_time_parts", """SELECT (t_block_ns // 3600000000000) % 24 AS hour, (t_block_ns // 86400000000000 + 3) % 7 AS dow, CASE horizon WHEN '5m' THEN 300 WHEN '15m' THEN 900 WHEN '1h' THEN 3600 ELSE -1 END AS horizon_s, count(*) AS n FROM fills GROUP BY ALL""")
def time_parts(spark, sf):
    t = F.col("t_block_ns")
    return V.fills(spark, sf).groupBy(M.hour_utc(t).alias("hour"), M.day_of_week(t).alias("dow"), M.horizon_seconds(F.col("horizon")).alias("horizon_s")).agg(F.count("*").alias("n"))


@register("c30_wide_result_compare", """WITH o AS (SELECT asset_symbol AS metric, sum(size) AS value FROM fills WHERE block_number % 2 = 0 GROUP BY 1), w AS (SELECT asset_symbol AS metric, sum(size) AS value FROM fills WHERE block_number % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.metric, w.metric) AS metric, o.value AS old, w.value AS new, 100 * (w.value - o.value) / abs(o.value) AS delta_pct, coalesce(abs(100 * (w.value - o.value) / abs(o.value)) > 10, TRUE) AS flagged FROM o FULL JOIN w ON o.metric = w.metric""", "old new delta_pct")
def compare(spark, sf):
    part = lambda k: V.fills(spark, sf).where(F.col("block_number") % 2 == k).groupBy(F.col("asset_symbol").alias("metric")).agg(F.sum("size").alias("value"))
    return X.wide_result_compare(part(0), part(1))


@register("e1_first_order_stats", """SELECT * FROM (SELECT count(*) AS n_fills, count_if(is_maker) AS n_maker, count_if(NOT is_maker) AS n_taker, count_if(side = 'BUY') AS n_buy, count_if(side = 'SELL') AS n_sell, 100 * avg(CASE WHEN side = 'BUY' THEN 1 ELSE 0 END) AS pct_buy, sum(size) AS size_total, avg(size) AS size_mean,
    quantile_cont(price, 0.05) AS price_p5, quantile_cont(price, 0.25) AS price_p25, quantile_cont(price, 0.5) AS price_p50, quantile_cont(price, 0.75) AS price_p75, quantile_cont(price, 0.95) AS price_p95 FROM fills),
    (SELECT count(*) AS n_tokens, quantile_cont(c, 0.5) AS fills_per_token_p50, quantile_cont(c, 0.9) AS fills_per_token_p90, max(c) AS fills_per_token_max FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM fills GROUP BY token_id))""",
    "pct_buy size_total size_mean price_p5 price_p25 price_p50 price_p75 price_p95 fills_per_token_p50 fills_per_token_p90 fills_per_token_max", 8)
def stats(spark, sf):
    return X.first_order_stats(V.fills(spark, sf)).withColumn("fills_per_token_max", F.col("fills_per_token_max").cast("double"))


def exposure_steps(spark, sf):
    """Fills with positions and changes of exposure, stored, as totals read them twice."""
    return V.stored(X.exposure_steps(V.fills(spark, sf)).select("block_number", "log_index", "token_id", "size", "price", "side", "position", "__step"))


@register("f1_inventory_series", "SELECT token_id, block_number, log_index, size, price, position, exposure FROM inv", "position exposure")
def inventory(spark, sf):
    return X.inventory_series(V.fills(spark, sf)).select("token_id", "block_number", "log_index", "size", "price", "position", "exposure")


@register("e2_peak_inventory", """SELECT token_id, count(*) AS n_fills, max(position) AS max_position, min(position) AS min_position, max(abs(position)) AS peak_abs, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) AS final_position, max(exposure) AS max_exposure FROM inv GROUP BY 1""", "max_position min_position peak_abs final_position max_exposure")
def peaks(spark, sf):
    return X.peak_inventory(X.inventory_series(V.fills(spark, sf)))


@register("f3_total_exposure", """WITH s AS (SELECT *, exposure - coalesce(lag(exposure) OVER (PARTITION BY token_id ORDER BY block_number, log_index, size, price, side), 0) AS step FROM inv)
    SELECT token_id, block_number, log_index, size, sum(step) OVER (ORDER BY block_number, log_index, token_id, size, price, side ROWS UNBOUNDED PRECEDING) AS total_exposure FROM s""", "total_exposure", 7)
def exposure(spark, sf):
    return X.total_exposure(exposure_steps(spark, sf)).select("token_id", "block_number", "log_index", "size", "total_exposure")


@register("e20_exposure_stats", """WITH s AS (SELECT *, exposure - coalesce(lag(exposure) OVER (PARTITION BY token_id ORDER BY block_number, log_index, size, price, side), 0) AS step FROM inv),
    t AS (SELECT sum(step) OVER (ORDER BY block_number, log_index, token_id, size, price, side ROWS UNBOUNDED PRECEDING) AS x FROM s) SELECT max(x) AS max, avg(x) AS mean, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95 FROM t""", "max mean p90 p95", 3)
def exposure_stats(spark, sf):
    return X.exposure_stats(V.stored(X.total_exposure(exposure_steps(spark, sf)).select("total_exposure")))


@register("e21_peak_stats", """WITH p AS (SELECT token_id, max(abs(position)) AS peak_abs, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) AS f FROM inv GROUP BY 1)
    SELECT quantile_cont(peak_abs, 0.5) AS peak_p50, quantile_cont(peak_abs, 0.9) AS peak_p90, quantile_cont(peak_abs, 0.95) AS peak_p95, 100 * avg(CASE WHEN abs(f) < 0.001 THEN 1 ELSE 0 END) AS pct_net_zero, quantile_cont(f, 0.5) AS final_p50 FROM p""", "peak_p50 peak_p90 peak_p95 pct_net_zero final_p50")
def peak_stats(spark, sf):
    return X.peak_stats(X.peak_inventory(X.inventory_series(V.fills(spark, sf))))


@register("e3_skew_by", """SELECT CASE WHEN grouping(asset_symbol) = 1 THEN 'all' ELSE asset_symbol END AS asset_symbol, CASE WHEN grouping(horizon) = 1 THEN 'all' ELSE horizon END AS horizon, sum(canonical_sign * size) AS net_size, sum(size) AS gross_size, count(*) AS n, 100 * sum(canonical_sign * size) / sum(size) AS net_pct
    FROM canon GROUP BY GROUPING SETS ((asset_symbol), (horizon), (asset_symbol, horizon), ())""", "net_size gross_size net_pct")
def skew(spark, sf):
    return X.skew_by(canon(spark, sf), ["asset_symbol", "horizon"])


@register("e4_fill_coverage", "SELECT asset_symbol, horizon, count(*) AS n, count_if(block_number IN (SELECT event_id FROM events)) AS matched, avg(CASE WHEN block_number IN (SELECT event_id FROM events) THEN 1 ELSE 0 END) AS coverage FROM fills GROUP BY 1, 2", "coverage")
def coverage(spark, sf):
    ids = V.table(spark, sf, "events").select(F.col("event_id").alias("block_number")).distinct().withColumn("hit", F.lit(True))
    return X.fill_coverage_by(V.fills(spark, sf).join(ids, "block_number", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), ["asset_symbol", "horizon"], "hit")


@register("e5_market_pnl", "SELECT * FROM mpnl", "rebate mtm mean_sign net")
def market_pnl(spark, sf):
    """Flagship: fills, signs, resolutions and rebates to one row a market."""
    return X.market_pnl(marked(spark, sf))


@register("e6_pnl_strata", "SELECT outcome_type, sum(net) AS net, count(*) AS n_markets, avg(net) AS mean_net, abs(sum(net)) / sum(abs(sum(net))) OVER () AS share_of_abs FROM mpnl WHERE outcome_type IS NOT NULL GROUP BY 1", "net mean_net share_of_abs", 4)
def strata(spark, sf):
    return X.pnl_strata(X.market_pnl(marked(spark, sf)))


@register("e7_pnl_by_asset", "SELECT asset_symbol, sum(maker_rebate) AS rebate, sum(mtm) AS mtm, sum(maker_rebate + coalesce(mtm, 0)) AS net, avg(up_wins) AS up_rate FROM marked GROUP BY 1", "rebate mtm net up_rate", 4)
def pnl_asset(spark, sf):
    return X.pnl_by(marked(spark, sf), "asset_symbol")


@register("e8_realized_cashflow", "SELECT CAST(sum(CASE WHEN side = 'SELL' THEN 1 ELSE -1 END * CAST(price AS DECIMAL(12,6)) * CAST(size AS DECIMAL(12,2))) AS DOUBLE) AS trade_cash, sum(maker_rebate) AS rebates FROM fills", "trade_cash rebates", 3)
def cashflow(spark, sf):
    return X.realized_cashflow(V.fills(spark, sf)).withColumn("trade_cash", F.col("trade_cash").cast("double"))


@register("e9_max_possible_loss", """SELECT market, sum(CASE WHEN canonical_sign = 1 THEN up_price ELSE 1 - up_price END * size) AS max_loss, sum(price * size) AS notional, sum(mtm) AS mtm,
    coalesce(-sum(mtm) <= sum(CASE WHEN canonical_sign = 1 THEN up_price ELSE 1 - up_price END * size) + 1, TRUE) AS within FROM marked GROUP BY 1""", "max_loss notional mtm")
def max_loss(spark, sf):
    return X.max_possible_loss(marked(spark, sf))


@register("e10_pnl_daily", "SELECT t_block_ns // 86400000000000 AS slot, sum(maker_rebate + coalesce(mtm, 0)) AS net, count(*) AS n FROM marked GROUP BY 1", "net")
def pnl_daily(spark, sf):
    return X.pnl_over(marked(spark, sf), 86400)


@register("e11_volume_by_date", "SELECT CAST(make_timestamp(t_block_ns // 1000) AS DATE) AS date, sum(price * size) AS notional, count(*) AS n FROM fills GROUP BY 1", "notional")
def volume(spark, sf):
    return X.volume_by_date(V.fills(spark, sf))


@register("e12_dup_report", "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_keys, count_if(n > 1) AS dup_groups, sum(v - o) AS notional_excess FROM (SELECT block_number, log_index, count(*) AS n, sum(price * size) AS v, max(price * size) AS o FROM fills GROUP BY 1, 2)", "notional_excess", 3)
def dups(spark, sf):
    return X.dup_report(V.fills(spark, sf), ["block_number", "log_index"])


@register("e13_quantile_summary", """SELECT asset_symbol, horizon, count(size) AS n, quantile_cont(size, 0.25) AS p25, quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.75) AS p75, min(size) AS min, max(size) AS max, stddev_samp(size) AS std, quantile_cont(size, 0.75) - quantile_cont(size, 0.25) AS iqr FROM fills GROUP BY 1, 2""", "p25 p50 p75 min max std iqr")
def quantiles(spark, sf):
    return X.quantile_summary(V.fills(spark, sf), ["asset_symbol", "horizon"], "size")


@register("e15_first_fill", """SELECT market, asset_symbol, horizon, t_block_ns, price, n FROM (SELECT *, count(*) OVER (PARTITION BY market) AS n, row_number() OVER (PARTITION BY market ORDER BY t_block_ns, block_number, log_index, size, price, token_id) AS rn FROM fills) WHERE rn = 1""")
def first_fill(spark, sf):
    return X.first_fill(V.fills(spark, sf).withColumn("time_to_expiry_s", F.lit(0.0))).drop("time_to_expiry_s")


@register("e16_market_span", "SELECT market, min(t_block_ns) AS first_ns, max(t_block_ns) AS last_ns, string_agg(DISTINCT outcome_side, ',' ORDER BY outcome_side) AS sides FROM fills GROUP BY 1")
def span(spark, sf):
    return X.market_span(V.fills(spark, sf))


@register("e17_selection_rate", """SELECT m.horizon, count(DISTINCT m.market) AS available, count(DISTINCT f.market) AS traded, count(DISTINCT f.market) / count(DISTINCT m.market) AS rate
    FROM markets m LEFT JOIN (SELECT DISTINCT market FROM fills) f ON m.market = f.market GROUP BY 1""", "rate")
def selection(spark, sf):
    return X.selection_rate(V.fills(spark, sf), V.markets(spark, sf), "horizon")


def by_asset(spark, sf, report):
    """report(fills of an asset) for each, with the asset: all fills together reach every market."""
    f, out = V.fills(spark, sf), None
    for x in V.ASSETS:
        part = report(f.where(F.col("asset_symbol") == x)).withColumn("asset_symbol", F.lit(x))
        out = out.unionByName(part) if out else part
    return out


@register("e17_selection_rate_by_asset", " UNION ALL ".join(f"""SELECT '{x}' AS asset_symbol, m.horizon, count(DISTINCT m.market) AS available, count(DISTINCT f.market) AS traded, count(DISTINCT f.market) / count(DISTINCT m.market) AS rate
    FROM markets m LEFT JOIN (SELECT DISTINCT market FROM fills WHERE asset_symbol = '{x}') f ON m.market = f.market GROUP BY 2""" for x in V.ASSETS), "rate")
def selection_by_asset(spark, sf):
    m = V.markets(spark, sf)
    return by_asset(spark, sf, lambda f: X.selection_rate(f, m, "horizon"))


@register("e18_e19_settlement", """WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'PayoutRedemption' WHEN 'O' THEN 'PositionsMerge' ELSE 'Transfer' END AS event, CAST(o_orderkey % 4000 AS VARCHAR) AS token_id FROM orders), t AS (SELECT DISTINCT token_id FROM fills)
    SELECT event, count(*) AS n, count(DISTINCT token_id) AS n_tokens, 100.0 * count(DISTINCT token_id) / (SELECT count(*) FROM t) AS pct_of_traded FROM s WHERE token_id IN (SELECT token_id FROM t) GROUP BY 1""", "pct_of_traded")
def settlement(spark, sf):
    e = V.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "PayoutRedemption").when(F.col("o_orderstatus") == "O", "PositionsMerge").otherwise("Transfer").alias("event"), (F.col("o_orderkey") % 4000).cast("string").alias("token_id"))
    return X.settlement_events(e, V.fills(spark, sf))


@register("e19_timing_report", """WITH s AS (SELECT epoch_us(o_orderdate) * 1000 + (o_orderkey % 86400) * 1000000000 AS t_ns, CAST(o_orderkey % 4000 AS VARCHAR) AS token_id FROM orders), f AS (SELECT token_id, min(t_block_ns) AS first_ns FROM fills GROUP BY 1)
    SELECT (t_ns // 3600000000000) % 24 AS hour, count(*) AS n, avg(CASE WHEN t_ns < first_ns THEN 1 ELSE 0 END) AS before_first_fill FROM s JOIN f ON s.token_id = f.token_id GROUP BY 1""", "before_first_fill")
def timing(spark, sf):
    e = V.table(spark, sf, "orders").select((F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + (F.col("o_orderkey") % 86400) * M.NS).alias("t_ns"), (F.col("o_orderkey") % 4000).cast("string").alias("token_id"))
    return X.timing_report(e, V.fills(spark, sf))


@register("e22_histogram", "SELECT CAST(least(floor(price / 0.05), 19) AS INT) AS bin, count(*) AS n FROM fills WHERE price BETWEEN 0 AND 1 GROUP BY 1")
def hist(spark, sf):
    return X.histogram(V.fills(spark, sf), "price", 20, 0.0, 1.0)


@register("e23_clock_offset", """SELECT *, median_s < 5 AS median_ok, p99_s < 30 AS p99_ok FROM (SELECT quantile_cont((t_recv_ns - t_block_ns) / 1e9, 0.5) AS median_s, quantile_cont((t_recv_ns - t_block_ns) / 1e9, 0.99) AS p99_s, count(*) AS n FROM fills)""", "median_s p99_s")
def clock(spark, sf):
    return X.clock_offset_stats(V.fills(spark, sf))


@register("e30_alignment_share", """SELECT asset_symbol, avg(CASE WHEN (CASE WHEN up_price > 0.5 THEN 'Down' WHEN up_price < 0.5 THEN 'Up' ELSE 'ATM' END) = outcome_side THEN 1 ELSE 0 END) AS aligned, avg(CASE WHEN up_price > 0.5 THEN 1 ELSE 0 END) AS above_half FROM canon GROUP BY 1""", "aligned above_half")
def alignment(spark, sf):
    return X.alignment_share(canon(spark, sf), "asset_symbol")


@register("e31_market_notional", "SELECT market, sum(price * size) AS notional, count(*) AS n, sum(size) AS size FROM fills GROUP BY 1", "notional size")
def notional(spark, sf):
    return X.market_notional(V.fills(spark, sf))


@register("e32_fills_by_account", """WITH r AS (SELECT 'acct' || (l_suppkey % 5) AS account, 1 AS made, l_partkey FROM lineitem UNION ALL SELECT 'acct' || ((l_suppkey + 2) % 5), 0, l_partkey FROM lineitem)
    SELECT account, count(*) AS n, CAST(sum(made) AS BIGINT) AS n_maker, count(DISTINCT l_partkey) AS n_tokens FROM r WHERE account IN ('acct0', 'acct3') GROUP BY 1""")
def by_account(spark, sf):
    return X.fills_by_account(V.chain_events(spark, sf), ["acct0", "acct3"])


@register("e33_event_type_counts", "SELECT 'spot' AS feed, event_type, count(*) AS n FROM events GROUP BY 2")
def kinds(spark, sf):
    return X.event_type_counts(V.table(spark, sf, "events").withColumn("feed", F.lit("spot")))


TRANSFERS = "SELECT 'acct' || (o_custkey % 7) AS from_, 'acct' || (o_orderkey % 5) AS \"to\", CASE WHEN o_orderkey % 2 = 0 THEN 'USDC' ELSE 'pUSD' END AS token, o_totalprice AS amount FROM orders"


def transfers(spark, sf):
    return V.table(spark, sf, "orders").selectExpr("concat('acct', o_custkey % 7) as from_", "concat('acct', o_orderkey % 5) as to", "if(o_orderkey % 2 = 0, 'USDC', 'pUSD') as token", "o_totalprice as amount")


@register("e34_transfer_totals", f"""WITH t AS ({TRANSFERS}), e AS (SELECT token, from_ AS account, 0 AS i, amount AS o FROM t UNION ALL SELECT token, "to", amount, 0 FROM t)
    SELECT account, token, sum(i) AS total_in, sum(o) AS total_out FROM e WHERE account IN ('acct0', 'acct1', 'acct6') GROUP BY 1, 2""", "total_in total_out", 2)
def totals(spark, sf):
    return X.transfer_totals(transfers(spark, sf), ["acct0", "acct1", "acct6"])


@register("e35_bridge_edges", f"""WITH t AS ({TRANSFERS}) SELECT from_ AS account, CASE WHEN "to" = 'acct1' THEN 'wrap' ELSE 'unwrap' END AS edge, sum(amount) AS amount, count(*) AS n FROM t WHERE "to" IN ('acct1', 'acct2') GROUP BY 1, 2""", "amount", 2)
def bridges(spark, sf):
    return X.bridge_edges(transfers(spark, sf), "acct1", "acct2")


@register("e36_gate_table", """WITH m AS (SELECT count(*) AS n, avg(price) AS p FROM fills) SELECT 'enough' AS gate, CAST(n AS DOUBLE) AS value, 1000.0 AS "limit", n >= 1000 AS passed FROM m UNION ALL SELECT 'cheap', p, 0.4, p < 0.4 FROM m""", "value")
def gates(spark, sf):
    m = V.fills(spark, sf).agg(F.count("*").alias("n"), F.avg("price").alias("p"))
    return X.gate_table(m, {"enough": ("n", ">=", 1000), "cheap": ("p", "<", 0.4)})


@register("d6_side_agreement", """WITH p AS (SELECT 'x' || event_id AS tx_hash, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM events)
    SELECT n, agreement, agreement > 0.95 AS passed FROM (SELECT count(*) AS n, avg(CASE WHEN f.side = p.side THEN 1 ELSE 0 END) AS agreement FROM fills f JOIN p ON f.tx_hash = p.tx_hash)""", "agreement")
def agreement(spark, sf):
    p = V.table(spark, sf, "events").selectExpr("concat('x', event_id) as tx_hash", "if(event_id % 2 = 0, 'BUY', 'SELL') as side")
    return X.side_agreement(V.fills(spark, sf), p)


@register("d14_d15_semi_anti", """SELECT 'semi' AS kind, count(*) AS n FROM fills WHERE market IN (SELECT market FROM resolved) UNION ALL SELECT 'anti', count(*) FROM fills WHERE market NOT IN (SELECT market FROM resolved)""")
def semi_anti(spark, sf):
    f, r = V.fills(spark, sf), V.resolved(spark, sf)
    count = lambda how: f.join(r, "market", how).agg(F.count("*").alias("n")).select(F.lit(how.removeprefix("left_")).alias("kind"), "n")
    return count("left_semi").union(count("left_anti"))


@register("d16_interval_overlap", """SELECT a.o_orderkey, count(b.o_orderkey) AS concurrent FROM market_slots a LEFT JOIN market_slots b ON a.asset_symbol = b.asset_symbol AND b.start_ns < a.start_ns AND a.start_ns < b.end_ns GROUP BY 1""")
def overlap(spark, sf):
    return ordered.interval_overlap_count(V.market_slots(spark, sf), ["asset_symbol"], "start_ns", "end_ns", "concurrent", 30 * 24 * ordered.HOUR_NS).select("o_orderkey", "concurrent")


@register("d19_reconcile_counts", """SELECT n_local, net_local, n_external, net_external, abs(n_local - n_external) / greatest(n_external, 1) AS n_gap, abs(net_local - net_external) / greatest(abs(net_external), 1e-9) AS net_gap, abs(n_local - n_external) / greatest(n_external, 1) <= 0.005 AS n_ok, abs(net_local - net_external) / greatest(abs(net_external), 1e-9) <= 0.001 AS net_ok
    FROM (SELECT count(*) AS n_local, sum(net) AS net_local FROM mpnl), (SELECT count(*) AS n_external, sum(net) AS net_external FROM mpnl WHERE n > 5)""", "net_local net_external n_gap net_gap", 4)
def recon(spark, sf):
    m = X.market_pnl(marked(spark, sf))
    return X.reconcile_counts(m, m.where("n > 5"))


@register("d20_reconcile_positions", """WITH a AS (SELECT market, net FROM mpnl WHERE CAST(substr(market, 2) AS INT) % 11 <> 0), b AS (SELECT market, round(net, 1) AS net FROM mpnl WHERE CAST(substr(market, 2) AS INT) % 13 <> 0),
    j AS (SELECT coalesce(a.market, b.market) AS market, a.net AS ours, b.net AS reported, coalesce(a.net, 0) - coalesce(b.net, 0) AS gap FROM a FULL JOIN b ON a.market = b.market)
    SELECT market, ours, reported, gap, 100 * abs(gap) / greatest(abs(reported), 1e-9) AS gap_pct, CASE WHEN ours IS NULL THEN 'missing' WHEN reported IS NULL THEN 'extra' WHEN abs(gap) < 0.01 THEN 'equal' ELSE 'differs' END AS status FROM j""", "ours reported gap gap_pct", 5)
def recon_positions(spark, sf):
    m = X.market_pnl(marked(spark, sf)).withColumn("k", F.substring("market", 2, 12).cast("int"))
    return X.reconcile_positions(m.where("k % 11 <> 0"), m.where("k % 13 <> 0").withColumn("net", F.round("net", 1)))


@register("g2_top_k", "SELECT token_id, count(*) AS n FROM fills GROUP BY 1 ORDER BY n DESC, token_id LIMIT 5")
def top(spark, sf):
    return R.top_k(V.fills(spark, sf), "token_id", 5)


@register("g3_top_value", "SELECT token_id AS value, n FROM (SELECT token_id, count(*) AS n FROM fills GROUP BY 1) ORDER BY n DESC, token_id DESC LIMIT 1")
def top_value(spark, sf):
    return R.top_value(V.fills(spark, sf), "token_id")


@register("f7_dedup_first", """SELECT token_id, block_number, log_index, size FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY block_number, log_index, size) AS rn FROM fills) WHERE rn = 1""")
def dedup(spark, sf):
    f = V.fills(spark, sf).select("token_id", "block_number", "log_index", "size")
    return ordered.dedup_first(f, ["token_id"], ["block_number", "log_index", "size"])


@register("h3_h6_set_ops", """WITH a AS (SELECT DISTINCT market FROM fills), b AS (SELECT market FROM resolved) SELECT 'both' AS kind, count(*) AS n FROM (SELECT market FROM a INTERSECT SELECT market FROM b) UNION ALL SELECT 'traded_only', count(*) FROM (SELECT market FROM a EXCEPT SELECT market FROM b)
    UNION ALL SELECT 'merged', count(*) FROM (SELECT market FROM a UNION SELECT market FROM b)""")
def sets(spark, sf):
    return set_counts(V.fills(spark, sf), V.resolved(spark, sf))


def set_counts(fills, resolved):
    a, b = fills.select("market").distinct(), resolved.select("market")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count(a.intersect(b), "both").union(count(a.subtract(b), "traded_only")).union(count(a.union(b).distinct(), "merged"))


@register("h3_h6_set_ops_by_asset", " UNION ALL ".join(f"""SELECT '{x}' AS asset_symbol, 'both' AS kind, count(*) AS n FROM (SELECT market FROM fills WHERE asset_symbol = '{x}' INTERSECT SELECT market FROM resolved) UNION ALL SELECT '{x}', 'traded_only', count(*) FROM (SELECT market FROM fills WHERE asset_symbol = '{x}' EXCEPT SELECT market FROM resolved)
    UNION ALL SELECT '{x}', 'merged', count(*) FROM (SELECT market FROM fills WHERE asset_symbol = '{x}' UNION SELECT market FROM resolved)""" for x in V.ASSETS))
def sets_by_asset(spark, sf):
    r = V.resolved(spark, sf)
    return by_asset(spark, sf, lambda f: set_counts(f, r))
