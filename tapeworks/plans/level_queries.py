"""Queries over order-book levels, as-of joins and quote patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as L
from ..operators import ordered as O
from . import views as V
from .registry import register

NS = 1_000_000_000


def levels(spark, sf):
    return L.level_changes(V.levels_raw(spark, sf))


@register("f2_level_changes", "SELECT token_id, price, side, t_recv_ns, size, size_before, delta, classification FROM levels", "delta")
def level_changes(spark, sf):
    return levels(spark, sf).select("token_id", "price", "side", "t_recv_ns", "size", "size_before", "delta", "classification")


@register("d7_asof_nearest", """WITH b AS (SELECT f.event_id, f.t_ns, t.t_ns AS bt, t.mid AS bm FROM book_fills f ASOF LEFT JOIN (SELECT * FROM ticks WHERE symbol = 'click') t ON f.t_ns >= t.t_ns),
    n AS (SELECT f.event_id, t.t_ns AS ft, t.mid AS fm FROM book_fills f ASOF LEFT JOIN (SELECT * FROM ticks WHERE symbol = 'click') t ON f.t_ns <= t.t_ns)
    SELECT b.event_id, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR b.t_ns - bt <= ft - b.t_ns) THEN bm ELSE fm END AS mid FROM b JOIN n ON b.event_id = n.event_id""", "mid")
def nearest(spark, sf):
    f = V.book_fills(spark, sf).withColumn("symbol", F.lit("click"))
    return O.asof_nearest(f, V.ticks(spark, sf), "t_ns", ["symbol"], {"mid": "mid"}).select("event_id", "mid")


@register("d8_asof_backward", "SELECT f.event_id, t.mid FROM (SELECT *, ['view','error','click','signup','purchase'][event_id % 5 + 1] AS symbol FROM book_fills) f ASOF LEFT JOIN ticks t ON f.symbol = t.symbol AND f.t_ns >= t.t_ns", "mid")
def backward(spark, sf):
    return O.asof_backward(probes(spark, sf), V.ticks(spark, sf), "t_ns", ["symbol"], {"mid": "mid"}).select("event_id", "mid")


def probes(spark, sf):
    return V.book_fills(spark, sf).withColumn("symbol", F.expr("element_at(array('view','error','click','signup','purchase'), cast(event_id % 5 as int) + 1)"))


@register("d9_asof_forward_clamped", """SELECT f.event_id, coalesce(t.mid, e.mid) AS mid FROM (SELECT *, ['view','error','click','signup','purchase'][event_id % 5 + 1] AS symbol FROM book_fills) f
    ASOF LEFT JOIN ticks t ON f.symbol = t.symbol AND f.t_ns <= t.t_ns LEFT JOIN (SELECT symbol, arg_max(mid, t_ns) AS mid FROM ticks GROUP BY 1) e ON f.symbol = e.symbol""", "mid")
def clamped(spark, sf):
    return O.asof_forward_clamped(probes(spark, sf), V.ticks(spark, sf), "t_ns", ["symbol"], {"mid": "mid"}).select("event_id", "mid")


DEC = "(SELECT * FROM levels WHERE classification = 'cancel_or_fill')"
NEW = "(SELECT * FROM levels WHERE classification = 'new_order')"


@register("d10_match_within", f"""SELECT f.event_id, min(d.t_recv_ns) AS t_decrease_ns FROM book_fills f LEFT JOIN {DEC} d ON f.token_id = d.token_id AND f.price = d.price AND d.t_recv_ns BETWEEN f.t_ns - 1800000000000 AND f.t_ns + 1800000000000 GROUP BY 1""")
def within(spark, sf):
    return O.match_within(V.book_fills(spark, sf), L.decreases(levels(spark, sf)), "t_ns", ["token_id", "price"], 1800 * NS, {"t_decrease_ns": "t_recv_ns"}, right_on="t_recv_ns").select("event_id", "t_decrease_ns")


@register("d11_latest_before", f"SELECT f.event_id, max(d.t_recv_ns) AS t_before_ns FROM book_fills f LEFT JOIN {NEW} d ON f.token_id = d.token_id AND f.price = d.price AND d.t_recv_ns < f.t_ns GROUP BY 1")
def before(spark, sf):
    return O.latest_before(V.book_fills(spark, sf), levels(spark, sf).where("classification = 'new_order'"), "t_ns", ["token_id", "price"], {"t_before_ns": "t_recv_ns"}, right_on="t_recv_ns").select("event_id", "t_before_ns")


@register("d12_next_after", f"SELECT f.event_id, min(d.t_recv_ns) AS t_next_ns FROM book_fills f JOIN {DEC} d ON f.token_id = d.token_id AND f.price = d.price AND d.t_recv_ns > f.t_ns GROUP BY 1")
def after(spark, sf):
    return O.next_after(V.book_fills(spark, sf), L.decreases(levels(spark, sf)), "t_ns", ["token_id", "price"], {"t_next_ns": "t_recv_ns"}, right_on="t_recv_ns").select("event_id", "t_next_ns").where("t_next_ns is not null")


@register("d13_exists_within", f"SELECT f.event_id, bool_or(d.t_recv_ns IS NOT NULL) AS again FROM book_fills f LEFT JOIN {NEW} d ON f.token_id = d.token_id AND d.t_recv_ns > f.t_ns AND d.t_recv_ns < f.t_ns + 3600000000000 GROUP BY 1")
def exists(spark, sf):
    return O.exists_within(V.book_fills(spark, sf), levels(spark, sf).where("classification = 'new_order'"), "t_ns", ["token_id"], 0, 3600 * NS, "again", right_on="t_recv_ns").select("event_id", "again")


LIFE = f"""SELECT f.event_id, f.token_id, f.price, m.d AS t_decrease_ns, max(o.t_recv_ns) AS t_order_ns, (m.d - max(o.t_recv_ns)) / 1e6 AS lifetime_ms
    FROM book_fills f LEFT JOIN (SELECT f.event_id, min(d.t_recv_ns) AS d FROM book_fills f JOIN {DEC} d ON f.token_id = d.token_id AND f.price = d.price AND d.t_recv_ns BETWEEN f.t_ns - 5000000000 AND f.t_ns + 5000000000 GROUP BY 1) m ON f.event_id = m.event_id
    LEFT JOIN (SELECT * FROM levels WHERE classification = 'new_order') o ON f.token_id = o.token_id AND f.price = o.price AND o.t_recv_ns < m.d GROUP BY 1, 2, 3, 4"""


@register("f4_quote_lifetime", LIFE, "lifetime_ms")
def lifetime(spark, sf):
    return L.quote_lifetime(levels(spark, sf), V.book_fills(spark, sf)).select("event_id", "token_id", "price", "t_decrease_ns", "t_order_ns", "lifetime_ms")


@register("d23_enrich_left", f"SELECT f.event_id, f.size, l.t_decrease_ns FROM book_fills f LEFT JOIN ({LIFE}) l ON f.event_id = l.event_id WHERE l.lifetime_ms IS NULL OR l.lifetime_ms >= 0")
def enrich(spark, sf):
    life = L.quote_lifetime(levels(spark, sf), V.book_fills(spark, sf)).select("event_id", "t_decrease_ns", "lifetime_ms")
    return V.book_fills(spark, sf).select("event_id", "size").join(life, "event_id", "left").where("lifetime_ms is null or lifetime_ms >= 0").drop("lifetime_ms")


PATTERNS = f"""SELECT n.token_id, n.price, n.side, n.t_recv_ns AS t_ns, e.t AS t_end_ns, (e.t - n.t_recv_ns) / 1e6 AS duration_ms,
      CASE WHEN EXISTS (SELECT 1 FROM book_fills f WHERE f.token_id = n.token_id AND f.price = n.price) THEN 'persistent'
        WHEN EXISTS (SELECT 1 FROM {NEW} a WHERE a.token_id = n.token_id AND a.side = n.side AND a.t_recv_ns > e.t AND a.t_recv_ns < e.t + 3600000000000) THEN 'repricing' ELSE 'pulled' END AS pattern
    FROM {NEW} n JOIN (SELECT n.token_id, n.price, n.side, n.t_recv_ns AS s, min(d.t_recv_ns) AS t FROM {NEW} n JOIN {DEC} d ON n.token_id = d.token_id AND n.price = d.price AND n.side = d.side AND d.t_recv_ns > n.t_recv_ns GROUP BY 1, 2, 3, 4) e
      ON n.token_id = e.token_id AND n.price = e.price AND n.side = e.side AND n.t_recv_ns = e.s"""


def patterns(spark, sf):
    return L.quote_patterns(levels(spark, sf), V.book_fills(spark, sf), 3600 * NS)


@register("f5_quote_patterns", PATTERNS, "duration_ms")
def quote_patterns(spark, sf):
    return patterns(spark, sf)


@register("e25_pattern_distribution", f"SELECT pattern, count(*) AS n, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.9) AS p90, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM ({PATTERNS}) GROUP BY 1", "p50 p90 pct", 3)
def distribution(spark, sf):
    return L.pattern_distribution(V.stored(patterns(spark, sf).select("pattern", "duration_ms")))


def split_patterns(spark, sf):
    """Patterns against all fills of each outcome: by outcome, as all fills together reach every level."""
    lv, f = levels(spark, sf), V.book_fills(spark, sf)
    of = lambda x: L.quote_patterns(lv, f.where(F.col("outcome_side") == x), 3600 * NS).withColumn("outcome", F.lit(x))
    return of("Up").unionByName(of("Down"))


SPLIT = " UNION ALL ".join("SELECT *, '{0}' AS outcome FROM ({1})".format(x, PATTERNS.replace("FROM book_fills f WHERE", f"FROM book_fills f WHERE f.outcome_side = '{x}' AND")) for x in ("Up", "Down"))


@register("f5_quote_patterns_by_outcome", SPLIT, "duration_ms")
def patterns_by_outcome(spark, sf):
    return split_patterns(spark, sf)


@register("e25_pattern_distribution_by_outcome", f"SELECT outcome, pattern, count(*) AS n, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.9) AS p90, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY outcome) AS pct FROM ({SPLIT}) GROUP BY 1, 2", "p50 p90 pct", 3)
def distribution_by_outcome(spark, sf):
    p = V.stored(split_patterns(spark, sf).select("outcome", "pattern", "duration_ms"))
    of = lambda x: L.pattern_distribution(p.where(F.col("outcome") == x)).withColumn("outcome", F.lit(x))
    return of("Up").unionByName(of("Down"))


CAUSES = f"""SELECT d.token_id, d.price, d.side, d.t_recv_ns AS t_ns, CASE WHEN EXISTS (SELECT 1 FROM book_fills f WHERE f.token_id = d.token_id AND f.price = d.price AND f.t_ns BETWEEN d.t_recv_ns - 900000000000 AND d.t_recv_ns + 900000000000) THEN 'fill'
      WHEN EXISTS (SELECT 1 FROM {NEW} a WHERE a.token_id = d.token_id AND a.t_recv_ns > d.t_recv_ns AND a.t_recv_ns < d.t_recv_ns + 900000000000) THEN 'reprice' ELSE 'pull' END AS cause FROM {DEC} d"""


@register("f19_decrease_cause", CAUSES)
def causes(spark, sf):
    return L.decrease_cause(levels(spark, sf), V.book_fills(spark, sf), 900 * NS)


@register("o11_submit_cancel_ratio", f"""WITH c AS ({CAUSES}) SELECT coalesce(s.token_id, p.token_id) AS token_id, coalesce(s.n, 0) AS submitted, coalesce(p.n, 0) AS pulled, s.n / p.n AS ratio
    FROM (SELECT token_id, count(*) AS n FROM {NEW} GROUP BY 1) s FULL JOIN (SELECT token_id, count(*) AS n FROM c WHERE cause = 'pull' GROUP BY 1) p ON s.token_id = p.token_id""", "ratio")
def ratio(spark, sf):
    lv = levels(spark, sf)
    return L.submit_cancel_ratio(lv, L.decrease_cause(lv, V.book_fills(spark, sf), 900 * NS))


@register("e26_updates_per_token", "SELECT count(*) AS n_tokens, quantile_cont(c, 0.25) AS p25, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.75) AS p75, quantile_cont(c, 0.9) AS p90, max(c) AS max FROM (SELECT count(*) AS c FROM levels GROUP BY token_id)", "p25 p50 p75 p90")
def updates(spark, sf):
    return L.updates_per_token(levels(spark, sf))


@register("o10_interarrival", """WITH g AS (SELECT token_id, (t_recv_ns - lag(t_recv_ns) OVER (PARTITION BY token_id ORDER BY t_recv_ns, price, side, size)) / 1e6 AS gap FROM levels)
    SELECT token_id, count(gap) AS n, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.9) AS p90, avg(CASE WHEN floor(gap) % 100 = 0 THEN 1 ELSE 0 END) AS on_grid FROM g WHERE gap IS NOT NULL GROUP BY 1""", "p50 p90 on_grid", 3)
def gaps(spark, sf):
    return L.interarrival(levels(spark, sf))


@register("d21_quote_post_time", """WITH f AS (SELECT * FROM book_fills), o AS (SELECT l.token_id, l.t_recv_ns FROM levels l WHERE classification = 'new_order' AND EXISTS (SELECT 1 FROM f WHERE f.token_id = l.token_id AND f.price = l.price AND f.side = l.side))
    SELECT i.token_id, i.t_ns, min(o.t_recv_ns) AS t_post_ns, (i.t_ns - min(o.t_recv_ns)) / 1e9 AS lag_s FROM (SELECT token_id, min(t_ns) AS t_ns FROM f GROUP BY 1) i JOIN o ON i.token_id = o.token_id AND o.t_recv_ns < i.t_ns AND o.t_recv_ns >= i.t_ns - 86400000000000 GROUP BY 1, 2""", "lag_s")
def post_time(spark, sf):
    return L.quote_post_time(V.book_fills(spark, sf), levels(spark, sf), 86400 * NS)


@register("d5_inner_on_market", "SELECT f.token_id, f.block_number, f.log_index, f.side, f.size, r.up_wins FROM fills f JOIN resolved r ON f.market = r.market")
def on_market(spark, sf):
    return L.inner_on_market(V.fills(spark, sf), V.resolved(spark, sf)).select("token_id", "block_number", "log_index", "side", "size", "up_wins")


def strikes(spark, sf):
    """A market for each symbol and day: its strike is the symbol's first mid of the day."""
    t = V.ticks(spark, sf).withColumn("day", F.floor(F.col("t_ns") / (86400 * NS)).cast("bigint"))
    s = t.groupBy("symbol", "day").agg(F.min_by("mid", "t_ns").alias("strike"))
    return s.select(F.concat_ws("-", "symbol", "day").alias("market"), "symbol", "strike", (F.col("day") * 86400 * NS).alias("start_ns"), ((F.col("day") + 1) * 86400 * NS - 1).alias("end_ns"))


CROSS = """SELECT market, symbol, t_ns, mid, CASE WHEN above THEN 'up' ELSE 'down' END AS direction FROM (
    SELECT s.symbol || '-' || s.day AS market, t.symbol, t.t_ns, t.mid, t.mid > s.strike AS above, lag(t.mid > s.strike) OVER (PARTITION BY s.symbol, s.day ORDER BY t.t_ns, t.mid) AS before
    FROM ticks t JOIN (SELECT symbol, t_ns // 86400000000000 AS day, arg_min(mid, t_ns) AS strike FROM ticks GROUP BY 1, 2) s ON t.symbol = s.symbol AND t.t_ns // 86400000000000 = s.day) WHERE before IS NOT NULL AND above <> before"""


@register("f6_strike_crossings", CROSS, "mid")
def crossings(spark, sf):
    return L.strike_crossings(V.ticks(spark, sf), strikes(spark, sf))


def _tagged(spark, sf):
    """Fills of the markets that the crossings are about: a symbol's large events of a day."""
    return V.ticks(spark, sf).where("mid > 150").select(F.concat_ws("-", "symbol", F.floor(F.col("t_ns") / (86400 * NS)).cast("bigint")).alias("market"), F.when(F.col("event_id") % 2 == 0, "Up").otherwise("Down").alias("outcome_side"), "t_ns")


@register("d17_crossing_to_fill", f"""WITH c AS ({CROSS}), f AS (SELECT symbol || '-' || (t_ns // 86400000000000) AS market, CASE WHEN event_id % 2 = 0 THEN 'Up' ELSE 'Down' END AS o, t_ns FROM ticks WHERE mid > 150)
    SELECT c.market, c.t_ns, c.direction, min(f.t_ns) AS t_fill_ns, (min(f.t_ns) - c.t_ns) / 1e9 AS latency_s FROM c JOIN f ON c.market = f.market AND f.o = CASE WHEN direction = 'up' THEN 'Up' ELSE 'Down' END AND f.t_ns > c.t_ns GROUP BY 1, 2, 3 HAVING min(f.t_ns) <= c.t_ns + 7200000000000""", "latency_s")
def to_fill(spark, sf):
    c = L.strike_crossings(V.ticks(spark, sf), strikes(spark, sf))
    return L.crossing_to_fill(c, _tagged(spark, sf), 7200 * NS).select("market", "t_ns", "direction", "t_fill_ns", "latency_s")


@register("d18_crossing_to_level_to_fill", f"""WITH c AS ({CROSS}), g AS (SELECT symbol || '-' || (t_ns // 86400000000000) AS market, t_ns, mid FROM ticks),
    n AS (SELECT c.market, c.t_ns, min(g.t_ns) AS t_level_ns FROM c JOIN g ON c.market = g.market AND g.mid < 130 AND g.t_ns > c.t_ns GROUP BY 1, 2)
    SELECT n.market, n.t_ns, t_level_ns, (t_level_ns - n.t_ns) / 1e9 AS latency_s, EXISTS (SELECT 1 FROM g WHERE g.market = n.market AND g.mid > 150 AND g.t_ns > t_level_ns AND g.t_ns < t_level_ns + 7200000000000) AS confirmed FROM n""", "latency_s")
def to_level(spark, sf):
    c = L.strike_crossings(V.ticks(spark, sf), strikes(spark, sf))
    lv = V.ticks(spark, sf).where("mid < 130").select(F.concat_ws("-", "symbol", F.floor(F.col("t_ns") / (86400 * NS)).cast("bigint")).alias("market"), F.col("t_ns").alias("t_recv_ns"), F.lit("new_order").alias("classification"))
    return L.crossing_to_level_to_fill(c, lv, _tagged(spark, sf).drop("outcome_side"), 7200 * NS).select("market", "t_ns", "t_level_ns", "latency_s", "confirmed")


@register("o3_attribute_fill", f"""SELECT d.token_id, d.price, d.t_recv_ns AS t_ns, round(-d.delta, 6) AS amount, CASE WHEN EXISTS (SELECT 1 FROM book_fills f WHERE f.token_id = d.token_id AND f.price = d.price AND round(f.size, 6) = round(-d.delta, 6) AND f.t_ns >= d.t_recv_ns AND f.t_ns <= d.t_recv_ns + 86400000000000) THEN 'fill' ELSE 'cancel' END AS cause FROM {DEC} d""")
def attribute(spark, sf):
    return L.attribute_fill(levels(spark, sf), V.book_fills(spark, sf), 86400 * NS)


@register("o13_size_vs_depth", "SELECT f.event_id, l.size AS available, CASE WHEN l.size <> 0 THEN f.size / l.size END AS share FROM book_fills f ASOF LEFT JOIN raw_levels l ON f.token_id = l.token_id AND f.price = l.price AND f.t_ns >= l.t_recv_ns", "available share")
def depth(spark, sf):
    return L.size_vs_depth(V.book_fills(spark, sf), V.levels_raw(spark, sf)).select("event_id", "available", "share")


@register("o8_fill_in", f"SELECT n.token_id, n.price, n.side, n.t_recv_ns AS t_ns, EXISTS (SELECT 1 FROM book_fills f WHERE f.token_id = n.token_id AND f.price = n.price AND f.t_ns > n.t_recv_ns AND f.t_ns < n.t_recv_ns + 3600000000000) AS filled FROM {NEW} n")
def fill_in(spark, sf):
    return L.fill_in(levels(spark, sf), V.book_fills(spark, sf), 3600 * NS).select("token_id", "price", "side", "t_ns", "filled")


LIVE = f"""SELECT n.token_id, n.price, n.side, n.t_recv_ns AS t_ns, least((SELECT min(d.t_recv_ns) FROM {DEC} d WHERE d.token_id = n.token_id AND d.price = n.price AND d.side = n.side AND d.t_recv_ns > n.t_recv_ns), c.t_close_ns) AS live_until_ns,
    EXISTS (SELECT 1 FROM book_fills f WHERE f.token_id = n.token_id AND f.price = n.price AND f.t_ns > n.t_recv_ns AND f.t_ns <= least(n.t_recv_ns + 3600000000000, c.t_close_ns, (SELECT min(d.t_recv_ns) FROM {DEC} d WHERE d.token_id = n.token_id AND d.price = n.price AND d.side = n.side AND d.t_recv_ns > n.t_recv_ns))) AS filled, n.size
    FROM {NEW} n LEFT JOIN (SELECT token_id, max(t_ns) - 86400000000000 AS t_close_ns FROM book_fills WHERE outcome_side = 'Up' GROUP BY 1) c ON n.token_id = c.token_id WHERE c.t_close_ns IS NULL OR n.t_recv_ns < c.t_close_ns"""


def live_orders(spark, sf):
    """New orders with fills while they are live; tokens of one outcome close a day before their last fill."""
    f = V.book_fills(spark, sf)
    closes = f.where("outcome_side = 'Up'").groupBy("token_id").agg((F.max("t_ns") - 86400 * NS).alias("t_close_ns"))
    return L.fill_while_live(levels(spark, sf), f, closes, 3600 * NS)


@register("o8_fill_while_live", f"SELECT token_id, price, side, t_ns, live_until_ns, filled FROM ({LIVE})")
def fill_while_live(spark, sf):
    return live_orders(spark, sf).drop("size")


@register("o8_fill_regression", f"SELECT u.term, CASE u.term WHEN 'const' THEN a ELSE b END AS coef, n FROM (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM (SELECT filled::INT AS y, size AS x FROM ({LIVE}))) s, (VALUES ('const'), ('size')) u(term)", "coef", 8)
def fill_regression(spark, sf):
    """The chance of a fill while live, on the order's size."""
    from ..operators import regress as R

    return R.ols(live_orders(spark, sf).withColumn("filled", F.col("filled").cast("double")), "filled", ["size"]).select("term", "coef", "n")


BOOKS = "SELECT event_id, 50 + event_id % 7 AS b0, 40 + event_id % 5 AS b1, value AS bs, value + 1 AS b1s, value * 2 AS xs, value + 3 AS x1s FROM events"


def books(spark, sf):
    level = lambda p, s: f"named_struct('price', cast({p} as string), 'size', cast({s} as string))"
    return V.table(spark, sf, "events").selectExpr("cast(event_id as string) as asset_id", "event_id as t_recv_ns", f"to_json(array({level('(50 + event_id % 7) / 100D', 'value')}, {level('(40 + event_id % 5) / 100D', 'value + 1D')})) as bids", f"to_json(array({level('(60 + event_id % 3) / 100D', 'value * 2D')}, {level('(61 + event_id % 3) / 100D', 'value + 3D')})) as asks")


@register("a25_book_levels", "SELECT side, depth, count(*) AS n, sum(price) AS price, sum(size) AS size FROM (SELECT 'bid' AS side, 0 AS depth, (50 + event_id % 7) / 100 AS price, value AS size FROM events UNION ALL SELECT 'bid', 1, (40 + event_id % 5) / 100, value + 1 FROM events UNION ALL SELECT 'ask', 0, (60 + event_id % 3) / 100, value * 2 FROM events UNION ALL SELECT 'ask', 1, (61 + event_id % 3) / 100, value + 3 FROM events) GROUP BY 1, 2", "price size", 3)
def book_levels(spark, sf):
    return L.book_levels(books(spark, sf)).groupBy("side", "depth").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.sum("size").alias("size"))


@register("f18_book_imbalance", "SELECT event_id AS t_recv_ns, CASE WHEN value > 0 THEN ln(value / (value * 2 + value + 3)) END AS imbalance FROM events", "imbalance")
def imbalance(spark, sf):
    return L.book_imbalance(books(spark, sf)).select("t_recv_ns", "imbalance")


@register("a26_explode_price_changes", "SELECT token_id, price, side, size, t_recv_ns FROM raw_levels WHERE token_id IN ('1', '2', '3', '5', '8')")
def explode_changes(spark, sf):
    msg = V.levels_raw(spark, sf).select(F.lit("price_change").alias("event_type"), "t_recv_ns", F.to_json(F.array(F.struct(F.col("token_id").alias("asset_id"), "price", F.col("size").cast("string").alias("size"), "side"))).alias("price_changes"))
    tokens = spark.createDataFrame([(x,) for x in ("1", "2", "3", "5", "8")], "token_id string")
    return L.explode_price_changes(msg, tokens).select("token_id", "price", "side", "size", "t_recv_ns")


def quoting(spark, sf):
    """Quote updates of a token and what may drive them, by the kind of event: sign-ups are updates, clicks its spot, purchases its
    volatility, views its imbalance, and errors change its inventory."""
    e = V.table(spark, sf, "events").selectExpr("cast(user_id % 40 as string) as token_id", "event_type", "unix_micros(cast(ts as timestamp)) * 1000 as t_ns", "value", "event_id")
    of = lambda kind: e.where(F.col("event_type") == kind).select("token_id", "t_ns", "value", "event_id")
    steps = of("error").withColumn("step", F.when(F.col("value") > 50, F.col("value")).otherwise(-F.col("value")))
    inventory = O.running_sum(steps, "step", ["token_id"], ["t_ns", "event_id"], "position", 86400 * NS).select("token_id", "t_ns", F.col("position").alias("value"), "event_id")
    return of("signup").select("token_id", "t_ns"), {"spot": (of("click"), 60.0), "sigma": (of("purchase"), 80.0), "imbalance": (of("view"), 100.0), "inventory": (inventory, 90.0)}


QUOTING = """e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS token_id, event_type, epoch_us(ts) * 1000 AS t_ns, value, event_id FROM events), q AS (SELECT token_id, t_ns FROM e WHERE event_type = 'signup'),
    d AS (SELECT token_id, t_ns, value, CASE event_type WHEN 'click' THEN 'spot' WHEN 'purchase' THEN 'sigma' ELSE 'imbalance' END AS driver FROM e WHERE event_type IN ('click', 'purchase', 'view')
      UNION ALL SELECT token_id, t_ns, sum(CASE WHEN value > 50 THEN value ELSE -value END) OVER (PARTITION BY token_id ORDER BY t_ns, event_id), 'inventory' FROM e WHERE event_type = 'error'),
    names AS (SELECT * FROM (VALUES ('spot', 60.0, 0), ('sigma', 80.0, 1), ('imbalance', 100.0, 2), ('inventory', 90.0, 3)) n(driver, threshold, i))"""


@register("o9_threshold_events", """WITH RECURSIVE n AS (SELECT symbol, t_ns, mid, row_number() OVER (PARTITION BY symbol ORDER BY t_ns, mid) AS i FROM ticks),
    s AS (SELECT symbol, i, t_ns, mid, mid AS ref, mid AS was, FALSE AS event FROM n WHERE i = 1 UNION ALL
      SELECT n.symbol, n.i, n.t_ns, n.mid, CASE WHEN n.mid >= s.ref + 40 OR n.mid <= s.ref - 40 THEN n.mid ELSE s.ref END, s.ref, n.mid >= s.ref + 40 OR n.mid <= s.ref - 40 FROM s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1)
    SELECT symbol, t_ns, mid, was AS ref FROM s WHERE event""", "mid ref")
def threshold_events(spark, sf):
    """Moves of 40 since the last one, symbol by symbol, in buckets of six hours."""
    from ..operators import triggers as G

    return G.threshold_events(V.ticks(spark, sf), ["symbol"], "t_ns", "mid", 40.0, 6 * 3600 * NS)


@register("o9_update_triggers", f"""WITH {QUOTING}, p AS (SELECT token_id, t_ns, lag(t_ns) OVER (PARTITION BY token_id ORDER BY t_ns) AS prev_ns FROM q),
    r AS (SELECT p.*, n.driver, n.threshold, n.i, (SELECT arg_max(value, d.t_ns) FROM d WHERE d.driver = n.driver AND d.token_id = p.token_id AND d.t_ns <= p.prev_ns) AS ref, (SELECT arg_max(value, d.t_ns) FROM d WHERE d.driver = n.driver AND d.token_id = p.token_id AND d.t_ns <= p.t_ns) AS now FROM p, names n),
    f AS (SELECT r.*, (SELECT min(d.t_ns) FROM d WHERE d.driver = r.driver AND d.token_id = r.token_id AND d.t_ns > r.prev_ns AND d.t_ns <= r.t_ns AND (d.value >= r.ref + r.threshold OR d.value <= r.ref - r.threshold)) AS hit FROM r)
    SELECT token_id, t_ns, max(now - ref) FILTER (WHERE driver = 'spot') AS spot_move, max(now - ref) FILTER (WHERE driver = 'inventory') AS inventory_move, CASE WHEN max(prev_ns) IS NULL THEN 'first' ELSE coalesce(arg_min(driver, {{'t': hit, 'i': i}}) FILTER (WHERE hit IS NOT NULL), 'none') END AS trigger FROM f GROUP BY 1, 2""", "spot_move inventory_move", 4)
def update_triggers(spark, sf):
    from ..operators import triggers as G

    quotes, drivers = quoting(spark, sf)
    return G.update_triggers(quotes, drivers, "token_id", width=86400 * NS, tie=["event_id"]).select("token_id", "t_ns", "spot_move", "inventory_move", "trigger")


@register("o9_trigger_regression", f"""WITH {QUOTING}, g AS (SELECT token_id, unnest(range(min(t_ns), max(t_ns) + 1, 14400000000000)) AS t_ns FROM q GROUP BY 1),
    v AS (SELECT g.*, n.driver, (SELECT arg_max(value, d.t_ns) FROM d WHERE d.driver = n.driver AND d.token_id = g.token_id AND d.t_ns <= g.t_ns) - (SELECT arg_max(value, d.t_ns) FROM d WHERE d.driver = n.driver AND d.token_id = g.token_id AND d.t_ns <= g.t_ns - 14400000000000) AS m FROM g, names n WHERE n.driver IN ('spot', 'inventory')),
    w AS (SELECT token_id, t_ns, coalesce(abs(max(m) FILTER (WHERE driver = 'spot')), 0) AS x1, coalesce(abs(max(m) FILTER (WHERE driver = 'inventory')), 0) AS x2, CASE WHEN EXISTS (SELECT 1 FROM q WHERE q.token_id = v.token_id AND q.t_ns > v.t_ns AND q.t_ns <= v.t_ns + 14400000000000) THEN 1.0 ELSE 0.0 END AS y FROM v GROUP BY 1, 2),
    m AS (SELECT covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM w),
    b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m) SELECT 'const' AS term, my - b1 * m1 - b2 * m2 AS coef, n FROM b UNION ALL SELECT 'spot', b1, n FROM b UNION ALL SELECT 'inventory', b2, n FROM b""", "coef", 7)
def trigger_regression(spark, sf):
    """Updates within four hours on the moves of spot and inventory over the four hours before."""
    from ..operators import triggers as G

    quotes, drivers = quoting(spark, sf)
    grid = G.trigger_grid(quotes, {n: drivers[n][0] for n in ("spot", "inventory")}, "token_id", 4 * 3600 * NS, width=86400 * NS, tie=["event_id"])
    return G.trigger_regression(grid, ["spot", "inventory"]).select("term", "coef", "n")
