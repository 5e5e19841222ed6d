"""Fill, position and profit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from .ordered import running_sum
from .selection import percentiles

FILL_COLUMNS = ["token_id", "market", "asset_symbol", "horizon", "outcome_side", "block_number", "log_index", "tx_hash", "t_block_ns", "t_recv_ns", "is_backfilled", "is_maker", "side", "price", "size", "maker_rebate", "time_to_expiry_s"]


def conform_columns(df: DataFrame, order: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Columns in a fixed order; missing ones as nulls, others dropped."""
    types = types or {}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in order])


def account_fills(events: DataFrame, account: str, exchanges: list[str]) -> DataFrame:
    return events.where((F.col("event") == "OrderFilled") & F.col("exchange").isin(exchanges) & ((F.col("maker") == account) | (F.col("taker") == account)))


def with_block_time(df: DataFrame, blocks: DataFrame) -> DataFrame:
    return df.join(blocks.select("block_number", "t_block_ns"), "block_number", "left")


def with_ws_time(df: DataFrame, prints: DataFrame) -> DataFrame:
    """Earliest trade print of each transaction; the block's time where there is none, and how it was timed."""
    first = prints.groupBy("tx_hash").agg(F.min("t_recv_ns").alias("t_print_ns"))
    d = df.join(first, "tx_hash", "left")
    return d.withColumns({"t_fill_ns": F.coalesce("t_print_ns", "t_block_ns"), "timing": F.when(F.col("t_print_ns").isNotNull(), "print").otherwise("block")}).drop("t_print_ns")


def with_market(df: DataFrame, markets: DataFrame) -> DataFrame:
    """Left join on the token; the market table has a row for each token."""
    return df.join(markets, "token_id", "left")


def build_fills(events: DataFrame, markets: DataFrame, account: str, exchanges: list[str]) -> DataFrame:
    """OrderFilled events of an account to one row a fill: side, price, size, rebate, market and time to expiry."""
    f = account_fills(events, account, exchanges).withColumns({"maker_units": M.raw_to_units(F.col("maker_amount_raw")).cast("double"), "taker_units": M.raw_to_units(F.col("taker_amount_raw")).cast("double")})
    side = F.col("side")
    f = f.withColumns({"price": F.round(M.fill_price(side, F.col("maker_units"), F.col("taker_units")), 6), "size": M.fill_size(side, F.col("maker_units"), F.col("taker_units")), "is_maker": F.col("maker") == account, "is_backfilled": M.flag_backfilled(F.col("t_recv_ns"), F.col("t_block_ns"))})
    f = f.withColumn("maker_rebate", M.maker_rebate(F.col("is_maker"), F.col("price"), F.col("size"))).withColumn("side", M.account_side(side))
    f = with_market(f, markets).withColumn("time_to_expiry_s", M.time_to_expiry_s(F.col("end_date_unix"), F.col("t_block_ns")))
    return conform_columns(f, FILL_COLUMNS)


def signed_size(side, size):
    return F.when(side == "BUY", size).otherwise(-size)


def inventory_series(fills: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Running position of each token in (block, log) order, and its exposure at the fill's price."""
    f = fills.withColumn("signed_size", signed_size(F.col("side"), F.col("size")))
    f = running_sum(f, "signed_size", ["token_id"], ["block_number", "log_index", "size", "price", "side"], "position", width)
    return f.withColumn("exposure", F.abs("position") * F.col("price"))


def peak_inventory(inv: DataFrame) -> DataFrame:
    at = F.struct("block_number", "log_index", "size", "price", "side")
    return inv.groupBy("token_id").agg(F.count("*").alias("n_fills"), F.max("position").alias("max_position"), F.min("position").alias("min_position"), F.max(F.abs("position")).alias("peak_abs"), F.max_by("position", at).alias("final_position"), F.max("exposure").alias("max_exposure"))


def exposure_steps(fills: DataFrame, width: int = 1_000_000) -> DataFrame:
    """inventory_series with __step, the change of the token's exposure, by one sort: a bucket begins with the position and price that the token had."""
    from pyspark.sql.window import Window as W

    order = ["block_number", "log_index", "size", "price", "side"]
    f = fills.where("block_number is not null").withColumns({"signed_size": signed_size(F.col("side"), F.col("size")), "__b": F.floor(F.col("block_number") / width).cast("bigint"), "__own": F.lit(True)})
    ends = f.groupBy("token_id", "__b").agg(F.sum("signed_size").alias("__s"), F.max_by("price", F.struct(*order)).alias("__p"))
    w = W.partitionBy("token_id").orderBy("__b")
    heads = ends.select("token_id", "__b", F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("signed_size"), F.lag("__p").over(w).alias("price"), F.lit(False).alias("__own")).where("signed_size is not null")
    w = W.partitionBy("token_id", "__b").orderBy("__own", *order)
    run = lambda last: F.sum("signed_size").over(w.rowsBetween(W.unboundedPreceding, last))
    d = f.unionByName(heads, allowMissingColumns=True).withColumns({"position": run(0), "__was": run(-1), "__paid": F.lag("price").over(w)}).where("__own")
    d = d.withColumn("exposure", F.abs("position") * F.col("price")).withColumn("__step", F.col("exposure") - F.coalesce(F.abs("__was") * F.col("__paid"), F.lit(0.0)))
    return d.drop("__b", "__own", "__was", "__paid")


def total_exposure(inv: DataFrame, width: int = 1_000, number: str | None = None) -> DataFrame:
    """At each fill, the sum over tokens of their latest exposure: a running sum of each token's changes, dealt by ranges of blocks.

    The changes are inv's __step (of exposure_steps, best stored, as this reads them twice), or else found here.
    """
    from pyspark.sql.window import Window as W

    order = ["block_number", "log_index", "token_id", "size", "price", "side"]
    step = F.col("exposure") - F.coalesce(F.lag("exposure").over(W.partitionBy("token_id").orderBy("block_number", "log_index", "size", "price", "side")), F.lit(0.0))
    steps = inv if "__step" in inv.columns else inv.withColumn("__step", step)
    return running_sum(steps.withColumn("__all", F.lit(0)), "__step", ["__all"], order, "total_exposure", width, number).drop("__step", "__all")


def first_order_stats(fills: DataFrame) -> DataFrame:
    """One row: counts by role and side, sizes, distinct tokens and price quantiles; fills per token from grouped counts."""
    one = fills.agg(
        F.count("*").alias("n_fills"), F.count_if("is_maker").alias("n_maker"), F.count_if(~F.col("is_maker")).alias("n_taker"),
        F.count_if(F.col("side") == "BUY").alias("n_buy"), F.count_if(F.col("side") == "SELL").alias("n_sell"), (100 * F.avg((F.col("side") == "BUY").cast("int"))).alias("pct_buy"),
        F.sum("size").alias("size_total"), F.avg("size").alias("size_mean"),
    )
    counts = fills.groupBy("token_id").count()
    per = counts.agg(F.count("*").alias("n_tokens"), F.max("count").alias("fills_per_token_max"))
    prices = percentiles(fills, "price", {f"price_p{p}": p / 100 for p in (5, 25, 50, 75, 95)})
    middle = percentiles(counts, "count", {"fills_per_token_p50": 0.5, "fills_per_token_p90": 0.9})
    for other in (prices, per, middle):
        one = one.crossJoin(F.broadcast(other))  # one row each
    return one


def with_canonical(fills: DataFrame) -> DataFrame:
    f = fills.withColumns({"canonical_sign": M.canonical_sign(F.col("side"), F.col("outcome_side")), "up_price": M.up_price(F.col("price"), F.col("outcome_side"))})
    up, sign = F.col("up_price"), F.col("canonical_sign")
    return f.withColumns({"atm_displacement": M.atm_displacement(up), "otm_cushion": M.otm_cushion(up), "adverse_selection": M.adverse_selection(up, sign), "rebate_favoured": M.rebate_favoured(up), "rebate_aligned": M.rebate_aligned(up, F.col("outcome_side"))})


def skew_by(fills: DataFrame, keys: list[str]) -> DataFrame:
    """Net and gross size by each key, by all of them and in total, from one pass of grouping sets. Absent keys read `all`."""
    net = F.col("canonical_sign") * F.col("size")
    f = fills.select(*[F.col(k).alias(f"__{k}") for k in keys], net.alias("__net"), F.col("size").alias("__size"))
    sets = [[F.col(f"__{k}")] for k in keys] + [[F.col(f"__{k}") for k in keys]] * (len(keys) > 1) + [[]]
    g = f.groupingSets(sets, *[F.col(f"__{k}") for k in keys])
    out = g.agg(*[F.grouping(f"__{k}").alias(f"__g_{k}") for k in keys], F.sum("__net").alias("net_size"), F.sum("__size").alias("gross_size"), F.count("*").alias("n"))
    named = [F.when(F.col(f"__g_{k}") == 1, "all").otherwise(F.col(f"__{k}")).alias(k) for k in keys]
    return out.select(*named, "net_size", "gross_size", "n", (100 * F.col("net_size") / F.col("gross_size")).alias("net_pct"))


def with_mtm(fills: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Mark-to-market of each fill at its market's resolution; null while unresolved."""
    f = fills.join(resolutions.select("market", "up_wins"), "market", "left")
    return f.withColumn("mtm", M.mtm_binary(F.col("canonical_sign"), F.col("up_wins"), F.col("up_price"), F.col("size")))


def market_pnl(fills: DataFrame) -> DataFrame:
    g = fills.groupBy("market", "asset_symbol", "horizon").agg(F.sum("maker_rebate").alias("rebate"), F.sum("mtm").alias("mtm"), F.first("up_wins", True).alias("up_wins"), F.avg("canonical_sign").alias("mean_sign"), F.count("*").alias("n"))
    return g.withColumns({"net": F.col("rebate") + F.coalesce("mtm", F.lit(0.0)), "outcome_type": M.outcome_type(F.col("mean_sign"), F.col("up_wins"))})


def pnl_strata(by_market: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window as W

    g = by_market.where("outcome_type is not null").groupBy("outcome_type").agg(F.sum("net").alias("net"), F.count("*").alias("n_markets"), F.avg("net").alias("mean_net"))
    return g.withColumn("share_of_abs", F.abs("net") / F.sum(F.abs("net")).over(W.partitionBy(F.lit(1))))


def pnl_by(fills: DataFrame, key: str) -> DataFrame:
    return fills.groupBy(key).agg(F.sum("maker_rebate").alias("rebate"), F.sum("mtm").alias("mtm"), F.sum(F.col("maker_rebate") + F.coalesce("mtm", F.lit(0.0))).alias("net"), F.avg("up_wins").alias("up_rate"))


def realized_cashflow(fills: DataFrame) -> DataFrame:
    cash = F.col("price").cast("decimal(12,6)") * F.col("size").cast("decimal(12,2)")
    return fills.agg(F.sum(F.when(F.col("side") == "SELL", cash).otherwise(-cash)).alias("trade_cash"), F.sum("maker_rebate").alias("rebates"))


def max_possible_loss(fills: DataFrame) -> DataFrame:
    """Worst case and cost basis of each market's fills in Up terms, and whether the result stays within."""
    long = F.col("canonical_sign") == 1
    worst = F.when(long, F.col("up_price")).otherwise(1 - F.col("up_price")) * F.col("size")
    g = fills.groupBy("market").agg(F.sum(worst).alias("max_loss"), F.sum(F.col("price") * F.col("size")).alias("notional"), F.sum("mtm").alias("mtm"))
    return g.withColumn("within", F.coalesce(-F.col("mtm") <= F.col("max_loss") + 1, F.lit(True)))


def pnl_over(fills: DataFrame, seconds: int, out: str = "slot") -> DataFrame:
    return fills.groupBy(M.bucket(F.col("t_block_ns"), seconds).alias(out)).agg(F.sum(F.col("maker_rebate") + F.coalesce("mtm", F.lit(0.0))).alias("net"), F.count("*").alias("n"))


def volume_by_date(fills: DataFrame) -> DataFrame:
    return fills.groupBy(F.to_date(M.ns_to_timestamp(F.col("t_block_ns"))).alias("date")).agg(F.sum(F.col("price") * F.col("size")).alias("notional"), F.count("*").alias("n"))


def dup_report(fills: DataFrame, keys: list[str]) -> DataFrame:
    g = fills.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("price") * F.col("size")).alias("v"), F.max(F.col("price") * F.col("size")).alias("one"))
    return g.agg(F.sum("n").alias("total"), F.count("*").alias("unique_keys"), F.count_if(F.col("n") > 1).alias("dup_groups"), F.sum(F.col("v") - F.col("one")).alias("notional_excess"))


def quantile_summary(df: DataFrame, keys: list[str], value: str, accuracy: int | None = None) -> DataFrame:
    """Number, quartiles, extremes and spread of each group. Exact quartiles by selection, or approximate ones (see percentiles)."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"))
    q = percentiles(df, value, {f"p{p}": p / 100 for p in (25, 50, 75)}, keys, accuracy=accuracy)
    q = q.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], "p25", "p50", "p75")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__q{i}"))
    return g.join(q, on, "left").select(*keys, "n", "p25", "p50", "p75", "min", "max", "std", (F.col("p75") - F.col("p25")).alias("iqr"))


def retention_by(df: DataFrame, key: str, reason: str = "reason") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(reason) == "ok").alias("kept"), F.avg((F.col(reason) == "ok").cast("int")).alias("kept_share"))


def first_fill(fills: DataFrame) -> DataFrame:
    at = F.struct("t_block_ns", "block_number", "log_index", "size", "price", "token_id")
    g = fills.groupBy("market").agg(F.min_by(F.struct("asset_symbol", "horizon", "t_block_ns", "price", "time_to_expiry_s"), at).alias("f"), F.count("*").alias("n"))
    return g.select("market", "f.*", "n")


def market_span(fills: DataFrame) -> DataFrame:
    return fills.groupBy("market").agg(F.min("t_block_ns").alias("first_ns"), F.max("t_block_ns").alias("last_ns"), F.array_join(F.sort_array(F.collect_set("outcome_side")), ",").alias("sides"))


def selection_rate(traded: DataFrame, available: DataFrame, key: str) -> DataFrame:
    a = available.groupBy(key).agg(F.count_distinct("market").alias("available"))
    t = traded.groupBy(key).agg(F.count_distinct("market").alias("traded"))
    return a.join(t, key, "left").select(key, "available", F.coalesce("traded", F.lit(0)).alias("traded"), (F.coalesce("traded", F.lit(0)) / F.col("available")).alias("rate"))


def fill_coverage_by(fills: DataFrame, keys: list[str], matched: str) -> DataFrame:
    return fills.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(matched).alias("matched"), F.avg(F.col(matched).cast("int")).alias("coverage"))


def side_agreement(fills: DataFrame, prints: DataFrame, least: float = 0.95) -> DataFrame:
    """Share of fills whose side is that of their transaction's print."""
    p = prints.groupBy("tx_hash").agg(F.min("side").alias("print_side"))
    j = fills.join(p, "tx_hash")
    return j.agg(F.count("*").alias("n"), F.avg((F.col("side") == F.col("print_side")).cast("int")).alias("agreement")).withColumn("passed", F.col("agreement") > least)


def reconcile_counts(local: DataFrame, external: DataFrame, n_gap: float = 0.005, pnl_gap: float = 0.001) -> DataFrame:
    """Counts and results of two sources of fills over one window, with gates. One row."""
    side = lambda df, name: df.agg(F.count("*").alias(f"n_{name}"), F.sum("net").alias(f"net_{name}"))
    j = side(local, "local").crossJoin(F.broadcast(side(external, "external")))
    j = j.withColumns({"n_gap": F.abs(F.col("n_local") - F.col("n_external")) / F.greatest("n_external", F.lit(1)), "net_gap": F.abs(F.col("net_local") - F.col("net_external")) / F.greatest(F.abs("net_external"), F.lit(1e-9))})
    return j.withColumns({"n_ok": F.col("n_gap") <= n_gap, "net_ok": F.col("net_gap") <= pnl_gap})


def reconcile_positions(local: DataFrame, reported: DataFrame) -> DataFrame:
    """Per market, our result against the reported one: gap, gap in percent, status."""
    j = local.select("market", F.col("net").alias("ours")).join(reported.select("market", F.col("net").alias("reported")), "market", "full")
    gap = F.coalesce("ours", F.lit(0.0)) - F.coalesce("reported", F.lit(0.0))
    j = j.withColumns({"gap": gap, "gap_pct": 100 * F.abs(gap) / F.greatest(F.abs("reported"), F.lit(1e-9))})
    return j.withColumn("status", F.when(F.col("ours").isNull(), "missing").when(F.col("reported").isNull(), "extra").when(F.abs("gap") < 0.01, "equal").otherwise("differs"))


def exposure_stats(series: DataFrame, value: str = "total_exposure") -> DataFrame:
    """One row. The series is read four times, so one that is costly to compute is best stored before."""
    one = series.agg(F.max(value).alias("max"), F.avg(value).alias("mean"))
    return one.crossJoin(F.broadcast(percentiles(series, value, {"p90": 0.9, "p95": 0.95})))  # one row each


def peak_stats(peaks: DataFrame) -> DataFrame:
    one = percentiles(peaks, "peak_abs", {"peak_p50": 0.5, "peak_p90": 0.9, "peak_p95": 0.95})
    zero = peaks.agg((100 * F.avg((F.abs("final_position") < 0.001).cast("int"))).alias("pct_net_zero"))
    return one.crossJoin(F.broadcast(zero)).crossJoin(F.broadcast(percentiles(peaks, "final_position", {"final_p50": 0.5})))  # one row each


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts of `bins` equal bins of [lo, hi]; the last one holds hi; values outside are left out."""
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def clock_offset_stats(fills: DataFrame) -> DataFrame:
    off = (F.col("t_recv_ns") - F.col("t_block_ns")) / 1e9
    one = percentiles(fills, off, {"median_s": 0.5, "p99_s": 0.99}).crossJoin(F.broadcast(fills.agg(F.count("*").alias("n"))))  # one row each
    return one.withColumns({"median_ok": F.col("median_s") < 5, "p99_ok": F.col("p99_s") < 30})


def alignment_share(fills: DataFrame, key: str) -> DataFrame:
    return fills.groupBy(key).agg(F.avg(F.col("rebate_aligned").cast("int")).alias("aligned"), F.avg((F.col("up_price") > 0.5).cast("int")).alias("above_half"))


def market_notional(fills: DataFrame) -> DataFrame:
    return fills.groupBy("market").agg(F.sum(F.col("price") * F.col("size")).alias("notional"), F.count("*").alias("n"), F.sum("size").alias("size"))


def fills_by_account(events: DataFrame, accounts: list[str]) -> DataFrame:
    roles = F.explode(F.array(F.struct(F.col("maker").alias("account"), F.lit(1).alias("made")), F.struct(F.col("taker").alias("account"), F.lit(0).alias("made"))))
    r = events.select("token_id", roles.alias("r")).select("token_id", "r.*").where(F.col("account").isin(accounts))
    return r.groupBy("account").agg(F.count("*").alias("n"), F.sum("made").alias("n_maker"), F.count_distinct("token_id").alias("n_tokens"))


def event_type_counts(df: DataFrame, feed: str = "feed", kind: str = "event_type") -> DataFrame:
    return df.groupBy(feed, kind).count().withColumnRenamed("count", "n")


def transfer_totals(transfers: DataFrame, accounts: list[str]) -> DataFrame:
    """Amounts in and out of each account, by token, by the transfer's direction."""
    ends = F.explode(F.array(F.struct(F.col("from_").alias("account"), F.lit(0.0).alias("i"), F.col("amount").alias("o")), F.struct(F.col("to").alias("account"), F.col("amount").alias("i"), F.lit(0.0).alias("o"))))
    t = transfers.select("token", ends.alias("e")).select("token", "e.*").where(F.col("account").isin(accounts))
    return t.groupBy("account", "token").agg(F.sum("i").alias("total_in"), F.sum("o").alias("total_out"))


def bridge_edges(transfers: DataFrame, on_ramp: str, off_ramp: str) -> DataFrame:
    kind = F.when(F.col("to") == on_ramp, "wrap").when(F.col("to") == off_ramp, "unwrap")
    return transfers.select(F.col("from_").alias("account"), kind.alias("edge"), "amount").where("edge is not null").groupBy("account", "edge").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


def settlement_events(events: DataFrame, traded: DataFrame) -> DataFrame:
    """Counts of settlement events by kind, and the share of traded tokens that have one."""
    n = traded.select("token_id").distinct().count()
    hit = events.join(traded.select("token_id").distinct(), "token_id", "left_semi")
    g = hit.groupBy("event").agg(F.count("*").alias("n"), F.count_distinct("token_id").alias("n_tokens"))
    return g.withColumn("pct_of_traded", 100 * F.col("n_tokens") / F.lit(max(n, 1)))


def timing_report(events: DataFrame, fills: DataFrame) -> DataFrame:
    """Settlement events by hour of day: number, and share before the token's first fill."""
    first = fills.groupBy("token_id").agg(F.min("t_block_ns").alias("first_ns"))
    j = events.join(first, "token_id")
    return j.groupBy(M.hour_utc(F.col("t_ns")).alias("hour")).agg(F.count("*").alias("n"), F.avg((F.col("t_ns") < F.col("first_ns")).cast("int")).alias("before_first_fill"))


def sign_audit(fills: DataFrame) -> DataFrame:
    """Results of SELL Down fills worked out from the Down side, against the formula in Up terms."""
    f = fills.where((F.col("side") == "SELL") & (F.col("outcome_side") == "Down") & F.col("up_wins").isNotNull())
    expected = F.col("price") * F.col("size") - (1 - F.col("up_wins")) * F.col("size")
    return f.agg(F.count("*").alias("n"), F.avg((F.abs(expected - F.col("mtm")) < 1e-6).cast("int")).alias("match_share"))


def gate_table(metrics: DataFrame, gates: dict[str, tuple[str, str, float]]) -> DataFrame:
    """A row for each gate (name: metric, comparison, limit) of a one-row table of metrics."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    rows = [F.struct(F.lit(n).alias("gate"), F.col(m).cast("double").alias("value"), F.lit(float(lim)).alias("limit"), F.coalesce(ops[op](F.col(m), F.lit(lim)), F.lit(False)).alias("passed")) for n, (m, op, lim) in gates.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def wide_result_compare(old: DataFrame, new: DataFrame, flag_pct: float = 10) -> DataFrame:
    """(metric, value) tables side by side: delta in percent, flagged beyond flag_pct."""
    j = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "metric", "full")
    j = j.withColumn("delta_pct", F.try_divide(100 * (F.col("new") - F.col("old")), F.abs("old")))
    return j.withColumn("flagged", F.coalesce(F.abs("delta_pct") > flag_pct, F.col("old").isNull() | F.col("new").isNull()))
