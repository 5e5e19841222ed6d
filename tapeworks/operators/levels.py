"""Order-book levels: changes, quote lifetimes, patterns and causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import money as M
from .ordered import asof_backward, asof_forward, exists_within, latest_before, match_within, next_after
from .selection import percentiles

NS = M.NS


def explode_price_changes(df: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Messages whose price_changes is a JSON array of updates -> a row for each; unreadable JSON gives none."""
    shape = "array<struct<asset_id:string,price:string,size:string,side:string>>"
    rows = df.where("event_type = 'price_change'").select("t_recv_ns", F.explode(F.from_json("price_changes", shape)).alias("c"))
    rows = rows.select("t_recv_ns", F.col("c.asset_id").alias("token_id"), M.norm_price(F.col("c.price")).alias("price"), F.col("c.side").alias("side"), M.num(F.col("c.size")).alias("size")).where("token_id is not null and price is not null")
    return rows if tokens is None else rows.join(tokens.select("token_id").distinct(), "token_id", "left_semi")


def level_changes(updates: DataFrame, eps: float = 0.001) -> DataFrame:
    """Each update's size before (0 at first) and classification at its (token, price, side): new_order, cancel_or_fill or no_change."""
    w = W.partitionBy("token_id", "price", "side").orderBy("t_recv_ns", "size")
    d = updates.withColumn("size_before", F.coalesce(F.lag("size").over(w), F.lit(0.0))).withColumn("delta", F.col("size") - F.col("size_before"))
    return d.withColumn("classification", F.when(F.col("delta") > eps, "new_order").when(F.col("delta") < -eps, "cancel_or_fill").otherwise("no_change"))


def decreases(levels: DataFrame) -> DataFrame:
    return levels.where(F.col("classification") == "cancel_or_fill")


def orders(levels: DataFrame) -> DataFrame:
    return levels.where(F.col("classification") == "new_order")


def quote_lifetime(levels: DataFrame, fills: DataFrame, tolerance_ns: int = 5 * NS, width: int = 3600 * NS) -> DataFrame:
    """Fills with the earliest decrease at their (token, price) within the tolerance and the last order there before it: lifetime in ms."""
    keys = ["token_id", "price"]
    m = match_within(fills, decreases(levels), "t_ns", keys, tolerance_ns, {"t_decrease_ns": "t_recv_ns"}, right_on="t_recv_ns", width=width)
    probe = m.withColumn("__t", F.coalesce("t_decrease_ns", F.lit(-1)))
    o = latest_before(probe, orders(levels), "__t", keys, {"t_order_ns": "t_recv_ns"}, right_on="t_recv_ns", width=width).drop("__t")
    o = o.withColumn("t_order_ns", F.when(F.col("t_decrease_ns").isNotNull(), F.col("t_order_ns")))
    return o.withColumn("lifetime_ms", (F.col("t_decrease_ns") - F.col("t_order_ns")) / 1e6)


def quote_patterns(levels: DataFrame, fills: DataFrame, within_ns: int = 5 * NS, width: int = 3600 * NS) -> DataFrame:
    """Each new order with the next decrease there: persistent (its level is ever filled), repricing (a new order of the token and side follows soon) or pulled."""
    new = levels.where("classification = 'new_order'").select("token_id", "price", "side", F.col("t_recv_ns").alias("t_ns"))
    q = next_after(new, decreases(levels), "t_ns", ["token_id", "price", "side"], {"t_end_ns": "t_recv_ns"}, right_on="t_recv_ns", width=width).where("t_end_ns is not null")
    filled = fills.select("token_id", "price").distinct().withColumn("__filled", F.lit(True))
    q = q.join(filled, ["token_id", "price"], "left")
    q = exists_within(q, new.select("token_id", "side", F.col("t_ns").alias("__nt")), "t_end_ns", ["token_id", "side"], 0, within_ns, "__again", right_on="__nt", width=width)
    kind = F.when(F.col("__filled"), "persistent").when(F.col("__again"), "repricing").otherwise("pulled")
    return q.select("token_id", "price", "side", "t_ns", "t_end_ns", ((F.col("t_end_ns") - F.col("t_ns")) / 1e6).alias("duration_ms"), kind.alias("pattern"))


def decrease_cause(levels: DataFrame, fills: DataFrame, tolerance_ns: int = 5 * NS, width: int = 3600 * NS) -> DataFrame:
    """Each decrease: fill (one within the tolerance at its price), reprice (any new order of the token soon after) or pull."""
    d = decreases(levels).select("token_id", "price", "side", F.col("t_recv_ns").alias("t_ns"))
    d = match_within(d, fills.select("token_id", "price", F.col("t_ns").alias("__ft")), "t_ns", ["token_id", "price"], tolerance_ns, {"t_fill_ns": "__ft"}, right_on="__ft", width=width)
    new = levels.where("classification = 'new_order'").select("token_id", F.col("t_recv_ns").alias("__nt"))
    d = exists_within(d, new, "t_ns", ["token_id"], 0, tolerance_ns, "__again", right_on="__nt", width=width)
    return d.select("token_id", "price", "side", "t_ns", F.when(F.col("t_fill_ns").isNotNull(), "fill").when(F.col("__again"), "reprice").otherwise("pull").alias("cause"))


def inner_on_market(quotes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Quotes with their market's attributes; quotes of markets without any go."""
    return quotes.join(attributes, "market")


def quote_post_time(fills: DataFrame, levels: DataFrame, max_lag_ns: int) -> DataFrame:
    """For each token's first fill: the first size increase before it, within max_lag, at a price and side where the account ever fills."""
    at = fills.select("token_id", "price", "side").distinct()
    own = orders(levels).join(at, ["token_id", "price", "side"], "left_semi").select("token_id", "t_recv_ns")
    first = fills.groupBy("token_id").agg(F.min("t_ns").alias("t_ns"))
    j = first.join(own, "token_id").where((F.col("t_recv_ns") < F.col("t_ns")) & (F.col("t_recv_ns") >= F.col("t_ns") - max_lag_ns))
    return j.groupBy("token_id", "t_ns").agg(F.min("t_recv_ns").alias("t_post_ns")).withColumn("lag_s", (F.col("t_ns") - F.col("t_post_ns")) / 1e9)


def strike_crossings(ticks: DataFrame, strikes: DataFrame, width: int = 3600 * NS) -> DataFrame:
    """Ticks of each market at which the mid passes its strike, with the direction.

    A market has a row for each bucket of time that it lives in, so that ticks meet only the markets of their symbol and bucket.
    """
    bucket = lambda t: F.floor(t / width).cast("bigint")
    live = strikes.where(F.col("start_ns") <= F.col("end_ns")).withColumn("__b", F.explode(F.sequence(bucket(F.col("start_ns")), bucket(F.col("end_ns")))))
    j = ticks.withColumn("__b", bucket(F.col("t_ns"))).join(live, ["symbol", "__b"]).where((F.col("t_ns") >= F.col("start_ns")) & (F.col("t_ns") <= F.col("end_ns")))
    j = j.withColumn("above", F.col("mid") > F.col("strike"))
    j = j.withColumn("before", F.lag("above").over(W.partitionBy("market").orderBy("t_ns", "mid")))
    return j.where("before is not null and above <> before").select("market", "symbol", "t_ns", "mid", F.when(F.col("above"), "up").otherwise("down").alias("direction"))


def crossing_to_fill(crossings: DataFrame, fills: DataFrame, cap_ns: int, width: int = 3600 * NS) -> DataFrame:
    """Each crossing with the first later fill on the favoured side of its market, within the cap."""
    c = crossings.withColumn("outcome_side", F.when(F.col("direction") == "up", "Up").otherwise("Down"))
    j = next_after(c, fills.select("market", "outcome_side", F.col("t_ns").alias("__ft")), "t_ns", ["market", "outcome_side"], {"t_fill_ns": "__ft"}, right_on="__ft", width=width)
    return j.where(F.col("t_fill_ns") <= F.col("t_ns") + cap_ns).withColumn("latency_s", (F.col("t_fill_ns") - F.col("t_ns")) / 1e9)


def crossing_to_level_to_fill(crossings: DataFrame, levels: DataFrame, fills: DataFrame, within_ns: int = 120 * NS, width: int = 3600 * NS) -> DataFrame:
    """Each crossing, the next new level of its market, and whether a fill confirms that within 120 s."""
    new = levels.where("classification = 'new_order'").select("market", F.col("t_recv_ns").alias("__nt"))
    c = next_after(crossings, new, "t_ns", ["market"], {"t_level_ns": "__nt"}, right_on="__nt", width=width).where("t_level_ns is not null")
    c = exists_within(c, fills.select("market", F.col("t_ns").alias("__ft")), "t_level_ns", ["market"], 0, within_ns, "confirmed", right_on="__ft", width=width)
    return c.withColumn("latency_s", (F.col("t_level_ns") - F.col("t_ns")) / 1e9)


def pattern_distribution(patterns: DataFrame, kind: str = "pattern", duration: str = "duration_ms") -> DataFrame:
    """Number, median and 90th percentile of the duration (by selection, over the whole of a pattern) and share of each pattern."""
    q = percentiles(patterns, duration, {"p50": 0.5, "p90": 0.9}, [kind]).withColumnRenamed(kind, "__kind")
    g = patterns.groupBy(kind).agg(F.count("*").alias("n")).join(q, F.col(kind).eqNullSafe(F.col("__kind")), "left").drop("__kind")
    return g.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def updates_per_token(levels: DataFrame) -> DataFrame:
    counts = levels.groupBy("token_id").count()
    return counts.agg(F.count("*").alias("n_tokens"), F.max("count").alias("max")).crossJoin(F.broadcast(percentiles(counts, "count", {f"p{p}": p / 100 for p in (25, 50, 75, 90)})))  # one row each


def interarrival(levels: DataFrame, grid_ms: int = 100) -> DataFrame:
    w = W.partitionBy("token_id").orderBy("t_recv_ns", "price", "side", "size")
    d = levels.withColumn("gap_ms", (F.col("t_recv_ns") - F.lag("t_recv_ns").over(w)) / 1e6).where("gap_ms is not null")
    return d.groupBy("token_id").agg(F.count("*").alias("n"), F.percentile("gap_ms", 0.5).alias("p50"), F.percentile("gap_ms", 0.9).alias("p90"), F.avg((F.pmod(F.floor("gap_ms"), F.lit(grid_ms)) == 0).cast("int")).alias("on_grid"))


def submit_cancel_ratio(levels: DataFrame, causes: DataFrame) -> DataFrame:
    s = levels.where("classification = 'new_order'").groupBy("token_id").agg(F.count("*").alias("submitted"))
    c = causes.where("cause = 'pull'").groupBy("token_id").agg(F.count("*").alias("pulled"))
    j = s.join(c, "token_id", "full").select("token_id", F.coalesce("submitted", F.lit(0)).alias("submitted"), F.coalesce("pulled", F.lit(0)).alias("pulled"))
    return j.withColumn("ratio", F.try_divide(F.col("submitted").cast("double"), F.col("pulled").cast("double")))


def book_levels(books: DataFrame) -> DataFrame:
    """Snapshots with JSON bids and asks -> a row for each level, best first."""
    shape = "array<struct<price:string,size:string>>"
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.from_json(c, shape).alias("levels")) for s, c in (("bid", "bids"), ("ask", "asks"))]))
    rows = books.select("asset_id", "t_recv_ns", sides.alias("s")).select("asset_id", "t_recv_ns", "s.side", F.posexplode("s.levels").alias("depth", "l"))
    return rows.select("asset_id", "t_recv_ns", "side", "depth", M.num(F.col("l.price")).alias("price"), M.num(F.col("l.size")).alias("size"))


def book_imbalance(books: DataFrame, tick: float = 0.01, ticks: int = 2) -> DataFrame:
    """ln of bid size over ask size within `ticks` of the best, from arrays of (price, size)."""
    shape = "array<struct<price:string,size:string>>"
    numbers = lambda c: F.transform(F.from_json(c, shape), lambda x: F.struct(M.num(x["price"]).alias("price"), M.num(x["size"]).alias("size")))
    b = books.withColumns({"__b": numbers("bids"), "__a": numbers("asks")})
    b = b.withColumns({"__bb": F.array_max(F.transform("__b", lambda x: x["price"])), "__ba": F.array_min(F.transform("__a", lambda x: x["price"]))})
    near = lambda side, keep: F.aggregate(F.filter(side, keep), F.lit(0.0), lambda acc, x: acc + x["size"])
    bid = near("__b", lambda x: x["price"] >= F.col("__bb") - ticks * tick - 1e-9)
    ask = near("__a", lambda x: x["price"] <= F.col("__ba") + ticks * tick + 1e-9)
    return b.withColumn("imbalance", F.when((bid > 0) & (ask > 0), F.log(bid / ask))).drop("__b", "__a", "__bb", "__ba")


def size_vs_depth(fills: DataFrame, depth: DataFrame, width: int = 3600 * NS) -> DataFrame:
    """Fill size over what was available at its (token, price) just before."""
    j = asof_backward(fills, depth, "t_ns", ["token_id", "price"], {"available": "size"}, right_on="t_recv_ns", width=width, tie=["size"])
    return j.withColumn("share", F.try_divide(F.col("size"), F.col("available")))


def fill_in(levels: DataFrame, fills: DataFrame, within_ns: int = 5 * NS, width: int = 3600 * NS) -> DataFrame:
    """New orders with the label whether a fill at their level follows within the time."""
    new = levels.where("classification = 'new_order'").select("token_id", "price", "side", F.col("t_recv_ns").alias("t_ns"), "size")
    return exists_within(new, fills.select("token_id", "price", F.col("t_ns").alias("__ft")), "t_ns", ["token_id", "price"], 0, within_ns, "filled", right_on="__ft", width=width)


def fill_while_live(levels: DataFrame, fills: DataFrame, closes: DataFrame, within_ns: int = 5 * NS, width: int = 3600 * NS) -> DataFrame:
    """New orders with `live_until_ns` and the label whether a fill at their level comes within the time and while they are live.

    An order lives until the next decrease at its (token, price, side) or its token's close (token_id, t_close_ns), whichever is first;
    a fill at that very moment counts. Tokens without a close stay open.
    """
    new = levels.where("classification = 'new_order'").select("token_id", "price", "side", F.col("t_recv_ns").alias("t_ns"), "size")
    q = next_after(new, decreases(levels), "t_ns", ["token_id", "price", "side"], {"t_cancel_ns": "t_recv_ns"}, right_on="t_recv_ns", width=width)
    q = q.join(closes.select("token_id", "t_close_ns"), "token_id", "left")
    q = next_after(q, fills.select("token_id", "price", F.col("t_ns").alias("__ft")), "t_ns", ["token_id", "price"], {"t_fill_ns": "__ft"}, right_on="__ft", width=width)
    live = F.least("t_cancel_ns", "t_close_ns")  # without nulls
    filled = F.col("t_fill_ns") <= F.least(F.col("t_ns") + within_ns, live)
    return q.where("t_close_ns is null or t_ns < t_close_ns").select("token_id", "price", "side", "t_ns", "size", live.alias("live_until_ns"), F.coalesce(filled, F.lit(False)).alias("filled"))


def attribute_fill(levels: DataFrame, fills: DataFrame, within_ns: int) -> DataFrame:
    """Decreases that equal a fill's amount at their level within the next blocks: fill, else cancel."""
    d = decreases(levels).select("token_id", "price", F.col("t_recv_ns").alias("t_ns"), F.round(-F.col("delta"), 6).alias("amount"))
    f = fills.select("token_id", "price", F.round("size", 6).alias("amount"), F.col("t_ns").alias("__ft"))
    j = asof_forward(d, f, "t_ns", ["token_id", "price", "amount"], {"t_fill_ns": "__ft"}, right_on="__ft")
    return j.withColumn("cause", F.when(F.col("t_fill_ns") <= F.col("t_ns") + within_ns, "fill").otherwise("cancel")).drop("t_fill_ns")
