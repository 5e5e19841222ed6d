"""Queries over pricing columns, regressions, tests, splits and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import pricing as P
from ..operators import fills as X
from ..operators import regress as R
from ..operators import selection as S
from . import views as V
from .fill_queries import canon, exposure_steps, marked
from .registry import register
from .vol_queries import pairs, rets


def xy(spark, sf):
    """Line items with a size to explain: y on two regressors, by time."""
    return V.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity as y", "l_extendedprice / 10000D as x1", "l_discount * 10D as x2", "l_tax * 10D as x3", "l_returnflag as g", "unix_micros(cast(l_shipdate as timestamp)) div 1000000 + l_orderkey % 86400 as t", "l_partkey", "l_suppkey")


XY = "(SELECT l_orderkey, l_linenumber, l_quantity AS y, l_extendedprice / 10000 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3, l_returnflag AS g, epoch_us(l_shipdate) // 1000000 + l_orderkey % 86400 AS t FROM lineitem)"


@register("l1_ols", f"""WITH d AS {XY}, s AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_r2(y, x1) AS r2, count(*) AS n, sqrt(regr_syy(y, x1) * (1 - regr_r2(y, x1)) / count(*)) AS rmse FROM d)
    SELECT 'ols' AS model, u.term, CASE u.term WHEN 'const' THEN a ELSE b END AS coef, r2, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, rmse, n FROM s, (VALUES ('const'), ('x1')) u(term)""", "coef r2 adj_r2 rmse")
def ols(spark, sf):
    return R.ols(xy(spark, sf), "y", ["x1"])


@register("l1_ols_by", f"""WITH d AS {XY}, s AS (SELECT g, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_r2(y, x1) AS r2, count(*) AS n, sqrt(regr_syy(y, x1) * (1 - regr_r2(y, x1)) / count(*)) AS rmse FROM d GROUP BY 1)
    SELECT g AS model, u.term, CASE u.term WHEN 'const' THEN a ELSE b END AS coef, r2, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, rmse, n FROM s, (VALUES ('const'), ('x1')) u(term)""", "coef r2 adj_r2 rmse")
def ols_by(spark, sf):
    return R.ols_by(xy(spark, sf), "y", ["x1"], "g")


@register("l2_ols_hac")
def hac(spark, sf):
    """Newey-West errors; tests hold them against a dense computation."""
    return R.ols_hac(xy(spark, sf), "y", ["x1", "x2"], ["t", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def cascaded(spark, sf):
    """Single regressors, all, then with effects of the flag, of flag and the line number's half, and of a high tax."""
    d = xy(spark, sf).withColumn("half", F.col("l_linenumber") > 3).withColumn("taxed", F.col("x3") > 0.4)
    return R.cascade(d, "y", {"price": ["x1"], "terms": ["x2", "x3"]}, [["g"], ["g", "half"], ["taxed"]], ["t", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@register("l3_cascade")
def cascade(spark, sf):
    return cascaded(spark, sf)


@register("l3_cascade_gate")
def cascade_gate(spark, sf):
    """Which of the joint models explain enough and keep the signs; tests hold it against NumPy."""
    return R.cascade_gate(V.stored(cascaded(spark, sf)))


@register("l4_vif", f"""WITH c AS (SELECT corr(x1, x2) AS r FROM {XY}) SELECT u.term, 1 / (1 - r * r) AS vif FROM c, (VALUES ('x1'), ('x2')) u(term)""", "vif")
def vif(spark, sf):
    return R.vif(xy(spark, sf), ["x1", "x2"])


@register("g6_temporal_split", f"SELECT g, t <= (SELECT quantile_cont(t, 0.7) FROM {XY}) AS train, count(*) AS n FROM {XY} GROUP BY 1, 2")
def split(spark, sf):
    return R.temporal_split(xy(spark, sf), "t", 0.7).groupBy("g", "train").agg(F.count("*").alias("n"))


@register("l5_oos_r2", f"""WITH d AS (SELECT *, t <= (SELECT quantile_cont(t, 0.7) FROM {XY}) AS train FROM {XY}), f AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM d WHERE train), e AS (SELECT d.*, y - a - b * x1 AS e FROM d, f WHERE NOT train)
    SELECT 'all' AS key, count(*) AS n, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, sqrt(avg(e * e)) AS rmse FROM e UNION ALL SELECT g, count(*), 1 - sum(e * e) / (var_pop(y) * count(*)), sqrt(avg(e * e)) FROM e GROUP BY 1""", "r2 rmse")
def oos(spark, sf):
    return R.oos_r2(R.temporal_split(xy(spark, sf), "t", 0.7), "y", ["x1"], by="g")


@register("l6_t_test", f"""WITH d AS {XY}, s AS (SELECT avg(y) FILTER (WHERE g = 'R') AS mean_true, avg(y) FILTER (WHERE g <> 'R') AS mean_false, count(*) FILTER (WHERE g = 'R') AS n_true, count(*) FILTER (WHERE g <> 'R') AS n_false, var_samp(y) FILTER (WHERE g = 'R') AS va, var_samp(y) FILTER (WHERE g <> 'R') AS vb FROM d),
    u AS (SELECT *, (mean_true - mean_false) / sqrt(((n_true - 1) * va + (n_false - 1) * vb) / (n_true + n_false - 2) * (1.0 / n_true + 1.0 / n_false)) AS t FROM s) SELECT mean_true, mean_false, n_true, n_false, t, abs(t) > 1.959963984540054 AS significant FROM u""", "mean_true mean_false t")
def t_test(spark, sf):
    return R.t_test(xy(spark, sf).withColumn("quoted", F.col("g") == "R"), "y", "quoted")


@register("l7_mean_hac", f"""WITH e AS (SELECT symbol, bar, r, r - avg(r) OVER (PARTITION BY symbol) AS e FROM rets WHERE r IS NOT NULL), l AS (SELECT *, {", ".join(f"lag(e, {j}) OVER (PARTITION BY symbol ORDER BY bar) AS l{j}" for j in range(1, 6))} FROM e)
    SELECT symbol, avg(r) AS mean, count(*) AS n, avg(r) / (sqrt(greatest(sum(e * e) + {" + ".join(f"2 * (1 - {j} / 6.0) * coalesce(sum(e * l{j}), 0)" for j in range(1, 6))}, 0)) / count(*)) AS t FROM l GROUP BY 1""", "mean t")
def mean_hac(spark, sf):
    return R.mean_hac(rets(spark, sf), "r", "symbol", ["bar"])


GRID = [{"slope": s, "level": a} for s in (1.0, 2.5, 4.0, 5.0) for a in (5.0, 10.0, 20.0)]


@register("l8_profile_grid", f"""WITH g AS (SELECT s.s AS slope, a.a AS level FROM (VALUES (1.0), (2.5), (4.0), (5.0)) s(s), (VALUES (5.0), (10.0), (20.0)) a(a)), v AS (SELECT slope, level, count(*) AS n, avg(power(y - level - slope * x1, 2)) AS v FROM {XY}, g GROUP BY 1, 2)
    SELECT CAST(slope AS DOUBLE) AS slope, CAST(level AS DOUBLE) AS level, n, -n / 2 * (ln(2 * pi() * v) + 1) AS loglik, max(-n / 2 * (ln(2 * pi() * v) + 1)) OVER () - (-n / 2 * (ln(2 * pi() * v) + 1)) <= 1.92 AS inside FROM v""", "loglik", 4)
def profile(spark, sf):
    return R.profile_grid(xy(spark, sf), F.col("y") - F.col("level") - F.col("slope") * F.col("x1"), ["slope", "level"], GRID)


@register("d22_grid_join", f"SELECT x1 > 5 AS high, k.k, sum(y * k.k) AS s FROM {XY}, (VALUES (0.5), (1.5)) k(k) GROUP BY 1, 2".replace("SELECT x1 > 5 AS high, k.k,", "SELECT x1 > 5 AS high, CAST(k.k AS DOUBLE) AS k,"), "s", 3)
def grid(spark, sf):
    return R.grid_join(xy(spark, sf), [{"k": 0.5}, {"k": 1.5}]).groupBy((F.col("x1") > 5).alias("high"), "k").agg(F.sum(F.col("y") * F.col("k")).alias("s"))


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def boosted(spark, sf):
    """Rows and trees of the size on price, discount and tax, earliest 70 % as training rows."""
    d = R.temporal_split(xy(spark, sf), "t", 0.7).dropna(subset=["y", "x1", "x2", "x3"])
    return d, R.gbt_fit(d, "y", ["x1", "x2", "x3"], LINE)


@register("l9_l11_gbt_residual")
def gbt(spark, sf):
    """Permutation importance."""
    d, error = boosted(spark, sf)
    return R.gbt_importances(d, error, "y", ["x1", "x2", "x3"], LINE)


@register("l9_gbt_by_group")
def gbt_by_group(spark, sf):
    """RMSE of both parts and of each group's test rows, with ratios."""
    d, error = boosted(spark, sf)
    return R.gbt_measures(d, error, "y", "g")


@register("l8_profile_refined")
def profile_refined(spark, sf):
    """The same model on a shrinking grid: all points that were tried, with the set within 1.92 of the best."""
    return R.profile_refined(xy(spark, sf), F.col("y") - F.col("level") - F.col("slope") * F.col("x1"), {"slope": (-4.0, 4.0), "level": (0.0, 60.0)}, 0.05)


@register("l10_gbt_select")
def gbt_select(spark, sf):
    d = R.temporal_split(xy(spark, sf), "t", 0.7).withColumn("label", (F.col("y") > 25).cast("double"))
    return R.gbt_select(d, "label", ["x1", "x2", "x3"], rounds=3, key=LINE)


@register("l12_sizing_ols", f"""WITH d AS (SELECT *, t <= (SELECT quantile_cont(t, 0.7) FROM {XY}) AS train FROM {XY}), f AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_r2(y, x1) AS r2, quantile_cont(y, 0.5) AS med FROM d WHERE train)
    SELECT g, sum(greatest(10, least(600, CASE WHEN r2 >= 0.3 THEN a + b * x1 ELSE med END))) AS size_hat, count(*) AS n FROM d, f GROUP BY 1""", "size_hat", 3)
def sizing(spark, sf):
    d = R.sizing_ols(R.temporal_split(xy(spark, sf), "t", 0.7), "y", ["x1"])
    return d.groupBy("g").agg(F.sum("size_hat").alias("size_hat"), F.count("*").alias("n"))


@register("l13_ar_k")
def ar(spark, sf):
    return R.ar_k(rets(spark, sf), "close", "symbol", ["bar"])


@register("l13_ar_1", """WITH d AS (SELECT close, lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS l, bar FROM bars), e AS (SELECT * FROM d WHERE l IS NOT NULL), c AS (SELECT quantile_cont(bar, 0.7) AS cut FROM e), f AS (SELECT regr_slope(close, l) AS b, regr_intercept(close, l) AS a FROM e, c WHERE bar <= cut)
    SELECT count(*) AS n, sqrt(avg(power(close - a - b * l, 2))) AS rmse, sqrt(avg(power(close - l, 2))) AS rmse_naive FROM e, c, f WHERE bar > cut""", "rmse rmse_naive")
def ar_1(spark, sf):
    return R.ar_k(rets(spark, sf), "close", "symbol", ["bar"], 1)


@register("l14_open_features", """WITH c AS (SELECT a.o_orderkey, count(b.o_orderkey) AS concurrent FROM market_slots a LEFT JOIN market_slots b ON a.asset_symbol = b.asset_symbol AND b.start_ns < a.start_ns AND a.start_ns < b.end_ns GROUP BY 1)
    SELECT s.o_orderkey, c.concurrent, (start_ns // 3600000000000) % 24 AS hour, (start_ns // 86400000000000 + 3) % 7 AS dow, CASE asset_symbol WHEN 'BTC' THEN 0 WHEN 'ETH' THEN 1 WHEN 'SOL' THEN 2 WHEN 'XRP' THEN 3 ELSE -1 END AS asset_code, s.o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem) AS traded FROM market_slots s JOIN c ON s.o_orderkey = c.o_orderkey""")
def open_features(spark, sf):
    from ..operators.ordered import HOUR_NS, interval_overlap_count

    m = interval_overlap_count(V.market_slots(spark, sf), ["asset_symbol"], "start_ns", "end_ns", "concurrent", 30 * 24 * HOUR_NS)
    traded = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("__t", F.lit(True))
    m = m.join(traded, "o_orderkey", "left")
    t = F.col("start_ns")
    return m.select("o_orderkey", "concurrent", M.hour_utc(t).alias("hour"), M.day_of_week(t).alias("dow"), M.coded(F.col("asset_symbol"), {"BTC": 0, "ETH": 1, "SOL": 2, "XRP": 3}).alias("asset_code"), F.coalesce("__t", F.lit(False)).alias("traded"))


OPT = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price, 100.0 AS strike, 100 * exp((l_quantity - 25.5) / 500) AS spot, (1 + l_linenumber) / 8760.0 AS tau, 0.3 + l_tax * 5 AS sigma FROM (SELECT *, CAST(20000 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 960001 AS DOUBLE) / 1000000 AS price FROM lineitem))"


def options(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(20000 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 960001 as double) / 1000000D as price", "100D as strike", "100D * exp((l_quantity - 25.5D) / 500D) as spot", "(1 + l_linenumber) / 8760D as tau", "0.3D + l_tax * 5D as sigma")


# The oracle's normal distribution sums the series of erf, which converges fast for |x| < 4.
PHI = "(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda n: ({x}) * power(({x}) * ({x}), n) / list_product(list_transform(range(0, n + 1), lambda k: CAST(2 * k + 1 AS DOUBLE))))))"

# Beyond, it takes the continued fraction of the tail.
TAIL = "(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) / list_reduce(list_concat([{x}], list_transform(range(60, 0, -1), lambda k: CAST(k AS DOUBLE))), lambda a, k: {x} + k / a))"


@register("k3_fair_value_up", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(d) < 4 THEN {PHI.format(x="d")} WHEN d > 0 THEN 1 - {TAIL.format(x="d")} ELSE {TAIL.format(x="(-d)")} END AS fair
    FROM (SELECT *, -ln(strike / spot) / (sigma * sqrt(tau)) AS d FROM {OPT})""", "fair", 7)
def fair(spark, sf):
    return options(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma")).alias("fair"))


CLIPPED = "fair = 0 or fair = 1"


@register("k3_fair_value_up_all")
def fair_all(spark, sf):
    """All rows; `clipped` where the fair value is nearer to 0 or 1 than a double can tell."""
    fair_ = P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma"))
    o = options(spark, sf).withColumn("fair", fair_)
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "fair", F.when(F.col("fair").isNull(), "invalid").when(F.expr(CLIPPED), "clipped").otherwise("ok").alias("reason"))


def returned(rows, close):
    """Counts of all rows by reason: a fair value at 0 or 1 has no inverse, one close to 1 has too few digits for an exact one."""
    reason = F.when(F.col("fair").isNull(), "invalid").when(F.expr(CLIPPED), "clipped").when(F.col("s").isNull(), "no_root").when(close, "ok").otherwise("imprecise")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@register("k1_k2_round_trip", "SELECT count(*) AS n, 0 AS off FROM lineitem")
def round_trip(spark, sf):
    """Rows whose price does not come back from the inverse: none."""
    d = options(spark, sf).withColumn("gap", F.abs(P.norm_cdf(P.norm_ppf(F.col("price"))) - F.col("price")))
    return d.agg(F.count("*").alias("n"), F.count_if((F.col("gap") > 1e-9) | F.col("gap").isNull()).cast("int").alias("off"))


@register("k4_implied_sigma", f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN price < 0.02 OR price > 0.98 THEN 'price_edge' WHEN abs(price - 0.5) < 0.02 THEN 'price_atm' WHEN abs(ln(strike / spot)) < 1e-4 THEN 'spot_atm'
    WHEN (ln(strike / spot) > 0) <> (price < 0.5) THEN 'sigma_range' ELSE 'ok_or_large' END AS reason FROM {OPT}) GROUP BY 1""")
def implied(spark, sf):
    o = options(spark, sf)
    _, reason = P.implied_sigma(F.col("price"), F.col("strike"), F.col("spot"), F.col("tau"))
    sign = (F.log(F.col("strike") / F.col("spot")) > 0) != (F.col("price") < 0.5)
    label = F.when((reason == "ok") | ((reason == "sigma_range") & ~sign), "ok_or_large").otherwise(reason)
    return o.select(label.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# Halley's steps on erf's series in Horner's form, from a rough line: |x| is below 2.1 here.
NEAR = "(0.5 + ({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_reduce(list_concat([CAST(1 AS DOUBLE)], list_transform(range(91, 1, -2), lambda k: CAST(k AS DOUBLE))), lambda a, k: 1 + ({x}) * ({x}) / k * a))"
PPF = "SELECT *, (p - 0.5) * 2.9 AS z0 FROM {table}"
for _step in range(5):
    PPF = f"SELECT *, z{_step} - e / (1 + z{_step} * e / 2) AS z{_step + 1} FROM (SELECT * EXCLUDE (e), ({NEAR.format(x=f'z{_step}')} - p) * sqrt(2 * pi()) * exp(z{_step} * z{_step} / 2) AS e FROM (SELECT *, 0 AS e FROM ({PPF})))".replace("SELECT *, z", "SELECT * EXCLUDE (e), z", 1)


@register("k4_implied_sigma_values", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN reason = 'ok' AND (s <= 0 OR s > 15) THEN 'sigma_range' ELSE reason END AS reason, CASE WHEN reason = 'ok' AND s > 0 AND s <= 15 THEN s END AS sigma FROM (
    SELECT *, CASE WHEN price < 0.02 OR price > 0.98 THEN 'price_edge' WHEN abs(price - 0.5) < 0.02 THEN 'price_atm' WHEN abs(ln(strike / spot)) < 1e-4 THEN 'spot_atm' ELSE 'ok' END AS reason, ln(strike / spot) / (sqrt(tau) * z5) AS s
    FROM ({PPF.format(table=f"(SELECT *, CASE WHEN price BETWEEN 0.02 AND 0.98 AND abs(price - 0.5) >= 0.02 THEN 1 - price ELSE 0.25 END AS p FROM {OPT})")}))""", "sigma", 6)
def implied_values(spark, sf):
    """Every row's implied volatility, or the reason why it has none."""
    sigma, reason = P.implied_sigma(F.col("price"), F.col("strike"), F.col("spot"), F.col("tau"))
    return options(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reason.alias("reason"), sigma.alias("sigma"))


@register("k5_implied_sigma_bounded", f"SELECT count(*) AS n, count(*) AS recovered FROM {OPT} WHERE abs(ln(strike / spot) / (sigma * sqrt(tau))) BETWEEN 0.01 AND 4")
def bounded(spark, sf):
    """Volatility comes back from the fair price it made."""
    o = options(spark, sf).where("abs(ln(strike / spot) / (sigma * sqrt(tau))) between 0.01 and 4")
    fair_ = P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma"))
    s = o.withColumn("fair", fair_).withColumn("s", P.implied_sigma_bounded(F.col("fair"), F.col("strike"), F.col("spot"), F.col("tau")))
    return s.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("s") - F.col("sigma")) < 1e-5).alias("recovered"))


@register("k5_implied_sigma_all")
def implied_sigma_all(spark, sf):
    """All rows, by what becomes of the volatility that the fair price gives back."""
    fair_ = P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma"))
    o = options(spark, sf).withColumn("fair", fair_).withColumn("s", P.implied_sigma_bounded(F.col("fair"), F.col("strike"), F.col("spot"), F.col("tau")))
    return returned(o, F.abs(F.col("s") - F.col("sigma")) < 1e-5)


@register("k5_implied_sigma_values", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN d < 5 THEN sigma END AS implied FROM (SELECT *, -ln(strike / spot) / (sigma * sqrt(tau)) AS d FROM {OPT})", "implied", 6)
def bounded_values(spark, sf):
    """Every row's volatility as its fair price gives it back; null where that price is too close to 1 for a double (the counts of k5_implied_sigma_all)."""
    o = options(spark, sf).withColumn("d", -F.log(F.col("strike") / F.col("spot")) / (F.col("sigma") * F.sqrt("tau"))).withColumn("fair", P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma")))
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("d") < 5, P.implied_sigma_bounded(F.col("fair"), F.col("strike"), F.col("spot"), F.col("tau"))).alias("implied"))


@register("k8_k10_quote_model", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.01, least(0.99, price - (0.01 + 0.1 * sigma * sqrt(tau)) + 0.05 * (0.5 - least(price, 1 - price)) + 0.002 + 0.01 * sigma * sqrt(tau))) AS quote,
    -0.1 * 5 * sigma * sigma * tau AS skew, 0.05 * (0.5 - least(price, 1 - price)) AS shift, 0.1 * sigma * sigma * tau / 2 + ln(1 + 0.1 / 1.5) / 0.1 AS half FROM {OPT}""", "quote skew shift half", 9)
def quotes(spark, sf):
    o, p = options(spark, sf), F.col("price")
    st = F.col("sigma") * F.sqrt("tau")
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.quote_model(p, F.lit(1.0), st, 0.01, 0.1, 0.05, 0.002, 0.01).alias("quote"), P.inventory_skew(F.lit(5.0), F.col("sigma"), F.col("tau"), 0.1).alias("skew"), P.rebate_shift(p, 0.05).alias("shift"), P.half_spread_as(F.col("sigma"), F.col("tau"), 0.1, 1.5).alias("half"))


@register("k9_residual", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price - (0.5 + CASE WHEN price > 0.5 THEN 1 ELSE -1 END * 0.01) AS residual FROM {OPT}", "residual", 9)
def residual(spark, sf):
    return options(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.residual(F.col("price"), F.lit(0.5), 0.01).alias("residual"))


@register("c28_c29_features", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber * 20 < 60 THEN abs(spot - strike) / strike END AS proximity, ln(tau) AS log_tau, sqrt(tau) AS sqrt_tau, sigma * sqrt(tau) AS sigma_sqrt_tau, abs(ln(spot / strike)) AS abs_log_move FROM {OPT}", "proximity log_tau sqrt_tau sigma_sqrt_tau abs_log_move")
def features(spark, sf):
    o = options(spark, sf)
    f = M.dist_features(F.col("tau"), F.col("sigma"), F.col("spot"), F.col("strike"), F.lit(1.0), F.lit(1.0))
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.spot_proximity(F.col("spot"), F.col("strike"), F.col("l_linenumber") * 20).alias("proximity"), *[f[k].alias(k) for k in ("log_tau", "sqrt_tau", "sigma_sqrt_tau", "abs_log_move")])


@register("e14_retention", f"""SELECT l_linenumber, count(*) AS total, count_if(price BETWEEN 0.1 AND 0.9) AS kept, avg(CASE WHEN price BETWEEN 0.1 AND 0.9 THEN 1 ELSE 0 END) AS kept_share FROM {OPT} GROUP BY 1""", "kept_share")
def retention(spark, sf):
    return X.retention_by(options(spark, sf).withColumn("reason", F.when(F.col("price").between(0.1, 0.9), "ok").otherwise("edge")), "l_linenumber")


@register("g5_sample_seeded", "SELECT token_id, market FROM markets ORDER BY md5(token_id || ':42'), token_id LIMIT 100")
def sample(spark, sf):
    return R.sample_seeded(V.markets(spark, sf), "token_id", 100).select("token_id", "market")


@register("g7_threshold_for_rate", f"SELECT quantile_cont(y, 1 - 0.647) AS threshold, count(*) AS n FROM {XY}", "threshold")
def threshold(spark, sf):
    return R.threshold_for_rate(xy(spark, sf), "y", 0.647)


@register("g8_bootstrap_ci")
def bootstrap(spark, sf):
    """200 rounds; tests hold the medians against the same weights row by row."""
    return S.bootstrap_ci(V.ticks(spark, sf), "mid", "event_id")


@register("g9_kfold")
def kfold(spark, sf):
    return R.kfold(V.markets(spark, sf), "market").groupBy("fold").agg(F.count("*").alias("n"))


BIAS = "cast(l_orderkey as string) || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"


def biases(spark, sf):
    """Price less fair value, times the side it lies on, and sigma sqrt(tau)."""
    d = options(spark, sf).withColumn("fair", P.fair_value_up(F.col("strike"), F.col("spot"), F.col("tau"), F.col("sigma")))
    return d.select(F.expr(BIAS).alias("k"), F.abs(F.col("price") - F.col("fair")).alias("bias"), (F.col("sigma") * F.sqrt("tau")).alias("st"))


@register("l16_bias_regression")
def bias(spark, sf):
    """Coefficients with intervals of 2,000 rounds, and whether those of another fit are inside; tests hold them against NumPy."""
    return S.bias_regression(biases(spark, sf), "bias", "st", "k", {"const": 0.5, "st": 0.0})


@register("l16_bias_coefficients", f"""SELECT u.term, CASE u.term WHEN 'const' THEN a ELSE b END AS coef, n FROM (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM (SELECT abs(price - CASE WHEN abs(d) < 4 THEN {PHI.format(x="d")} WHEN d > 0 THEN 1 - {TAIL.format(x="d")} ELSE {TAIL.format(x="(-d)")} END) AS y, sigma * sqrt(tau) AS x
    FROM (SELECT *, -ln(strike / spot) / (sigma * sqrt(tau)) AS d FROM {OPT}))) s, (VALUES ('const'), ('st')) u(term)""", "coef", 6)
def bias_coefficients(spark, sf):
    """The same fit without intervals."""
    return S.bias_regression(biases(spark, sf), "bias", "st", "k", {"const": 0.5, "st": 0.0}, rounds=1).select("term", "coef", "n")


@register("l17_vote", f"""WITH s AS (SELECT symbol, corr(close, lead) AS c FROM (SELECT b.*, c.close AS lead FROM rets b JOIN rets c ON b.bar = c.bar AND c.symbol = 'click') GROUP BY 1), v AS (SELECT count_if(c > 0.5) AS a, count_if(c <= 0.5 AND c < 0.0) AS b, count_if(NOT (c > 0.5) AND NOT (c < 0.0)) AS ambiguous FROM s)
    SELECT a, b, ambiguous, CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' ELSE 'ambiguous' END AS decision FROM v""")
def vote(spark, sf):
    c = pairs(spark, sf).groupBy("symbol").agg(F.corr("close", "lead").alias("c"))
    return R.vote(c, "c", 0.5, 0.0)


@register("o1_tte_distribution", """SELECT side, count(*) AS n, quantile_cont(tte, 0.25) AS p25, quantile_cont(tte, 0.5) AS p50, quantile_cont(tte, 0.75) AS p75 FROM (SELECT f.side, m.end_date_unix - f.t_block_ns / 1e9 AS tte FROM fills f JOIN markets m ON f.token_id = m.token_id) GROUP BY 1""", "p25 p50 p75", 3)
def tte(spark, sf):
    f = V.fills(spark, sf).join(V.markets(spark, sf).select("token_id", "end_date_unix"), "token_id").withColumn("tte", M.time_to_expiry_s(F.col("end_date_unix"), F.col("t_block_ns")))
    return X.quantile_summary(f, ["side"], "tte").select("side", "n", "p25", "p50", "p75")


@register("o2_builder_fingerprint", "SELECT l_suppkey AS builder, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 7 = 0) GROUP BY 1 ORDER BY n DESC, builder LIMIT 5")
def builders(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("builder"))
    own = li.where("builder % 7 = 0").select("l_partkey").distinct()
    return R.top_k(li.join(own, "l_partkey", "left_semi"), "builder", 5)


@register("o2_builder_fingerprint_both", """WITH a AS (SELECT l_suppkey AS builder, l_partkey FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT l_suppkey AS builder FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey IN (SELECT l_partkey FROM a)), t AS (SELECT builder, count(*) AS n_own FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
    SELECT t.builder, n_own, coalesce(n_others, 0) AS n_others, n_own / (SELECT count(*) FROM a) AS share_own, coalesce(n_others, 0) / (SELECT count(*) FROM o) AS share_others FROM t LEFT JOIN (SELECT builder, count(*) AS n_others FROM o GROUP BY 1) q ON t.builder = q.builder""", "share_own share_others", 9)
def builders_of_both(spark, sf):
    """An account's builders (returned lines) against those of all others on its markets."""
    li = V.table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("builder"), "l_returnflag")
    own = li.where("l_returnflag = 'R'")
    return R.top_k_of_both(own, li.where("l_returnflag <> 'R'").join(own.select("l_partkey").distinct(), "l_partkey", "left_semi"), "builder", 5)


@register("o4_inventory_skew_fit", """WITH s AS (SELECT *, exposure - coalesce(lag(exposure) OVER (PARTITION BY token_id ORDER BY block_number, log_index, size, price, side), 0) AS step FROM inv),
    d AS (SELECT price - 0.5 AS y, position AS x1, sum(step) OVER (ORDER BY block_number, log_index, token_id, size, price, side ROWS UNBOUNDED PRECEDING) / 1000 AS x2 FROM s),
    m AS (SELECT covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM d),
    b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m) SELECT 'const' AS term, my - b1 * m1 - b2 * m2 AS coef, n FROM b UNION ALL SELECT 'position', b1, n FROM b UNION ALL SELECT 'total_thousands', b2, n FROM b""", "coef", 7)
def skew_of_exposure(spark, sf):
    """Quote less fair on the token's position and the account's total exposure, with Newey-West errors (not in the result)."""
    d = V.stored(X.total_exposure(exposure_steps(spark, sf), number="at").select((F.col("price") - 0.5).alias("offset"), "position", (F.col("total_exposure") / 1000).alias("total_thousands"), "at"))
    return R.ols_hac(d, "offset", ["position", "total_thousands"], ["at"], number="at").select("term", "coef", "n")


@register("o4_o5_skew_spread_fit", "SELECT 'skew' AS model, u.term, CASE u.term WHEN 'const' THEN a ELSE b END AS coef FROM (SELECT regr_slope(price, position) AS b, regr_intercept(price, position) AS a FROM inv) s, (VALUES ('const'), ('position')) u(term)", "coef", 9)
def skew_fit(spark, sf):
    return R.ols(X.inventory_series(V.fills(spark, sf)), "price", ["position"], "skew").select("model", "term", "coef")


@register("o5_half_spread_fit", """WITH q AS (SELECT symbol, t_ns // 3600000000000 AS bar, (min(CASE WHEN event_id % 2 = 1 THEN mid END) - max(CASE WHEN event_id % 2 = 0 THEN mid END)) / 2 AS y, CAST(count(*) AS DOUBLE) AS x2 FROM ticks GROUP BY 1, 2),
    d AS (SELECT y, abs(r) AS x1, x2 FROM q JOIN rets s ON s.symbol = q.symbol AND s.bar = q.bar WHERE y IS NOT NULL AND r IS NOT NULL), m AS (SELECT covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM d),
    b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m) SELECT 'const' AS term, my - b1 * m1 - b2 * m2 AS coef FROM b UNION ALL SELECT 'sigma_sqrt_tau', b1 FROM b UNION ALL SELECT 'intensity', b2 FROM b""", "coef", 5)
def half_spreads(spark, sf):
    """Ticks as quotes of two sides by hour, with the hour's absolute return as its sigma sqrt(tau)."""
    t = V.ticks(spark, sf).select("symbol", F.floor(F.col("t_ns") / (3600 * 10**9)).cast("bigint").alias("bar"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("mid").alias("price"))
    sigma = rets(spark, sf).select("symbol", "bar", F.abs("r").alias("sigma_sqrt_tau"))
    return R.half_spread_fit(t, sigma, ["symbol", "bar"]).select("term", "coef")


@register("o6_rebate_band", "SELECT CAST(least(floor(up_price / 0.1), 9) AS INT) AS band, count(*) AS n, avg(price - 0.5) AS mean_offset, avg(0.014 * least(price, 1 - price)) AS rebate FROM canon GROUP BY 1", "mean_offset rebate", 9)
def band(spark, sf):
    b = F.least(F.floor(F.col("up_price") / 0.1), F.lit(9)).cast("int")
    return canon(spark, sf).groupBy(b.alias("band")).agg(F.count("*").alias("n"), F.avg(F.col("price") - 0.5).alias("mean_offset"), F.avg(0.014 * F.least(F.col("price"), 1 - F.col("price"))).alias("rebate"))


@register("o7_direction_logit")
def direction(spark, sf):
    f = canon(spark, sf).withColumn("label", (F.col("canonical_sign") == 1).cast("double"))
    return R.logit(f, "label", ["up_price", "size"])


@register("o12_match_metrics", """WITH a AS (SELECT t_block_ns AS v FROM fills WHERE block_number % 2 = 0), b AS (SELECT t_block_ns AS v FROM fills WHERE block_number % 2 = 1), g AS (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT v, 1 AS x, 0 AS y FROM a UNION ALL SELECT v, 0, 1 FROM b) GROUP BY 1)
    SELECT max(d) AS ks FROM (SELECT abs(sum(x) OVER (ORDER BY v) / sum(x) OVER () - sum(y) OVER (ORDER BY v) / sum(y) OVER ()) AS d FROM g)""", "ks")
def match(spark, sf):
    f = V.fills(spark, sf)
    return R.ks_distance(f.where("block_number % 2 = 0"), f.where("block_number % 2 = 1"), "t_block_ns")


TWIN = """WITH f AS (SELECT token_id, t_block_ns AS t, horizon, CASE WHEN side = 'BUY' THEN size ELSE -size END AS s, is_maker, maker_rebate + coalesce(mtm, 0) AS net, mtm > 0 AS won FROM marked), r AS (SELECT * FROM f), w AS (SELECT * REPLACE (t + 2700000000000 AS t) FROM f WHERE horizon <> '1h'),
    h AS (SELECT coalesce(sum(abs(coalesce(nt, 0) - coalesce(nr, 0))), 0) / sum(abs(coalesce(nr, 0))) AS hn, sum(abs(coalesce(pt, 0) - coalesce(pr, 0))) / sum(abs(coalesce(pr, 0))) AS hp FROM (SELECT t // 3600000000000 AS hour, count(*) AS nr, sum(net) AS pr FROM r GROUP BY 1) FULL JOIN (SELECT t // 3600000000000 AS hour, count(*) AS nt, sum(net) AS pt FROM w GROUP BY 1) USING (hour)),
    u AS (SELECT token_id, t, sum(x) AS x, sum(y) AS y FROM (SELECT token_id, t, s AS x, 0 AS y FROM r UNION ALL SELECT token_id, t, 0, s FROM w) GROUP BY 1, 2),
    p AS (SELECT sum(x) OVER o AS x, sum(y) OVER o AS y, (lead(t) OVER o - t) / 1e9 AS d FROM u WINDOW o AS (PARTITION BY token_id ORDER BY t)), m AS (SELECT sum(d) AS n, sum(d * x) / sum(d) AS mx, sum(d * y) / sum(d) AS my, sum(d * x * y) / sum(d) AS mxy, sum(d * x * x) / sum(d) AS mxx, sum(d * y * y) / sum(d) AS myy FROM p WHERE d IS NOT NULL),
    k AS (SELECT max(g) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY t) / sum(a) OVER () - sum(b) OVER (ORDER BY t) / sum(b) OVER ()) AS g FROM (SELECT t, sum(a) AS a, sum(b) AS b FROM (SELECT t, 1 AS a, 0 AS b FROM r UNION ALL SELECT t, 0, 1 FROM w) GROUP BY 1))),
    a AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM w) AS nt, (SELECT sum(net) FROM r) AS pr, (SELECT sum(net) FROM w) AS pt, (SELECT avg(is_maker::INT) FROM r) AS mr, (SELECT avg(is_maker::INT) FROM w) AS mt, (SELECT avg(won::INT) FROM r) AS wr, (SELECT avg(won::INT) FROM w) AS wt)
    SELECT 'fills' AS metric, abs(nt - nr) / nr AS gap FROM a UNION ALL SELECT 'hourly_fills', hn FROM h UNION ALL SELECT 'pnl', abs(pt - pr) / abs(pr) FROM a UNION ALL SELECT 'hourly_pnl', hp FROM h UNION ALL SELECT 'maker_share', abs(mt - mr) FROM a UNION ALL SELECT 'win_rate', abs(wt - wr) FROM a
    UNION ALL SELECT 'position_pearson', (mxy - mx * my) / sqrt((mxx - mx * mx) * (myy - my * my)) FROM m UNION ALL SELECT 'fill_time_ks', ks FROM k"""


@register("o12_match_metrics_all", TWIN, "gap", 7)
def match_all(spark, sf):
    """All fills against a twin that trades all but the long markets, 45 minutes later."""
    from ..operators import twin as W

    f = V.stored(marked(spark, sf).select("token_id", F.col("t_block_ns").alias("t_ns"), "horizon", X.signed_size(F.col("side"), F.col("size")).alias("signed_size"), "is_maker", (F.col("maker_rebate") + F.coalesce("mtm", F.lit(0.0))).alias("net"), (F.col("mtm") > 0).alias("won")))  # every measure reads it
    later = f.where("horizon <> '1h'").withColumn("t_ns", F.col("t_ns") + 2700 * 10**9)
    return W.match_metrics(f, later, 30 * 86400 * 10**9).select("metric", "gap")


@register("o14_rolling_refit", """WITH s AS (SELECT bar, count(*) AS n, sum(lead) AS sx, sum(close) AS sy, sum(lead * lead) AS sxx, sum(lead * close) AS sxy FROM (SELECT b.*, c.close AS lead FROM rets b JOIN rets c ON b.bar = c.bar AND c.symbol = 'click') GROUP BY 1),
    t AS (SELECT bar, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM s WINDOW w AS (ORDER BY bar RANGE 23 PRECEDING))
    SELECT bar, CAST(n AS BIGINT) AS n, CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM t WHERE n > 5""", "slope", 5)
def rolling(spark, sf):
    return R.rolling_refit(pairs(spark, sf), "close", "lead", "bar").where("n > 5").select("bar", "n", "slope")


@register("c20_mtm_spot", """WITH d AS (SELECT token_id, block_number, log_index, size, price, canonical_sign, up_price, 100.0 + size AS s_end, 120.0 AS strike, 100 + size / 2 AS s_fill, 110.0 AS s_post FROM canon)
    SELECT token_id, block_number, log_index, size, canonical_sign * (CASE WHEN s_end > strike THEN 1 ELSE 0 END - up_price) * size AS mtm, canonical_sign * (s_fill / s_post - 1) * price * size AS cost FROM d""", "mtm cost", 9)
def mtm_spot(spark, sf):
    c, s = canon(spark, sf), F.col("size")
    return c.select("token_id", "block_number", "log_index", "size", M.mtm_spot(F.col("canonical_sign"), 100 + s, F.lit(120.0), F.col("up_price"), s).alias("mtm"), M.as_cost(F.col("canonical_sign"), 100 + s / 2, F.lit(110.0), F.col("price"), s).alias("cost"))


@register("c21_outcome_type", "SELECT outcome_type, count(*) AS n FROM mpnl GROUP BY 1")
def outcomes(spark, sf):
    return X.market_pnl(marked(spark, sf)).groupBy("outcome_type").agg(F.count("*").alias("n"))
