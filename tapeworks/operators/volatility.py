"""Bars, returns and annualised volatility estimators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordered import asof_backward

NS = 1_000_000_000
YEAR_S = 365.25 * 86400


def bars(ticks: DataFrame, seconds: int = 60) -> DataFrame:
    """Open, high, low, close and time of the last tick of each bar of each symbol."""
    at, last = F.struct("t_ns", "mid"), F.struct("t_ns", "mid")
    return ticks.groupBy("symbol", F.floor(F.col("t_ns") / (seconds * NS)).cast("bigint").alias("bar")).agg(F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", last).alias("close"), F.max("t_ns").alias("t_ns"), F.count("*").alias("n_ticks"))


def by_symbol(order: str = "bar"):
    """Windows over bars: a symbol has a bar for each interval of its history at most, whatever its number of ticks."""
    return W.partitionBy("symbol").orderBy(order)


def log_returns(df: DataFrame, price: str = "close", order: str = "bar") -> DataFrame:
    return df.withColumn("r", F.log(F.col(price)) - F.log(F.lag(price).over(by_symbol(order))))


def rv(returns: Column, window, dt_s: float, year_s: float = YEAR_S, least: int = 2) -> Column:
    """Root mean square return, annualised; 0 for fewer than `least` returns."""
    return F.when(F.count(returns).over(window) < least, 0.0).otherwise(F.sqrt(F.avg(returns * returns).over(window)) * math.sqrt(year_s / dt_s))


def rv_rows(df: DataFrame, n: int, dt_s: float = 60, out: str = "rv", order: str = "bar") -> DataFrame:
    return df.withColumn(out, rv(F.col("r"), by_symbol(order).rowsBetween(-(n - 1), 0), dt_s))


def rv_range(df: DataFrame, span: int, dt_s: float = 60, out: str = "rv", order: str = "bar") -> DataFrame:
    """As rv_rows, over the last `span` intervals, however many bars are there."""
    return df.withColumn(out, rv(F.col("r"), by_symbol(order).rangeBetween(-(span - 1), 0), dt_s))


def rv_ticks(df: DataFrame, n: int, out: str = "rv_ticks") -> DataFrame:
    """Mean square return over the mean gap between ticks of the frame."""
    w = by_symbol("t_ns").rowsBetween(-n, 0)
    gap_s = (F.max("t_ns").over(w) - F.min("t_ns").over(w)) / F.greatest(F.count("*").over(w) - 1, F.lit(1)) / NS
    return df.withColumn(out, F.when((F.count("r").over(w) >= 2) & (gap_s > 0), F.sqrt(F.avg(F.col("r") * F.col("r")).over(w) / gap_s * YEAR_S)).otherwise(0.0))


def rv_bars(df: DataFrame, n: int, least: int = 30, seconds: int = 60, out: str = "rv_bars") -> DataFrame:
    w = by_symbol().rowsBetween(-n, 0)
    return df.withColumn(out, F.when(F.count("r").over(w) >= least, F.stddev_pop("r").over(w) * math.sqrt(YEAR_S / seconds)))


def ewma_trailing(df: DataFrame, lam: float, n: int = 1440, seed_rows: int = 10, seconds: int = 60, out: str = "ewma") -> DataFrame:
    """The recursion h = lam h + (1 - lam) r^2 over the last n returns, started at the variance of the first ones, annualised."""
    w = by_symbol().rowsBetween(-(n - 1), 0)
    rs = F.collect_list("r").over(w)

    def fold(xs):
        first = F.slice(xs, 1, seed_rows)
        mean = F.aggregate(first, F.lit(0.0), lambda a, x: a + x) / F.size(first)
        seed = F.aggregate(first, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(first)
        return F.aggregate(xs, seed, lambda h, x: h * lam + x * x * (1 - lam))

    d = df.withColumn("__rs", rs)
    return d.withColumn(out, F.when(F.size("__rs") >= 2, F.sqrt(fold(F.col("__rs"))) * math.sqrt(YEAR_S / seconds)).otherwise(0.0)).drop("__rs")


def ewma_series(df: DataFrame, lam: float, segment: int = 1440, out: str = "h", order: str = "bar") -> DataFrame:
    """The whole recursion from a symbol's first return (h = r^2 there), by segments of bars.

    A segment takes h before it to lam^m h + part. Two such steps are one of the same kind, so the steps of a symbol's segments are
    combined by doubling (with the segment one before, then two, four, ...), over a table with a row for each segment.
    """
    if lam**-segment > 1e250:
        raise ValueError("lam^-segment overflows: take a shorter segment")
    d = df.where("r is not null").withColumn("__seg", F.floor(F.col(order) / segment).cast("bigint"))
    own = W.partitionBy("symbol", "__seg").orderBy(order)
    d = d.withColumn("__i", F.row_number().over(own))
    weighted = F.col("r") * F.col("r") * (1 - lam) * F.pow(F.lit(lam), -F.col("__i"))
    steps = d.groupBy("symbol", "__seg").agg(F.count("*").alias("m"), F.sum(weighted).alias("s"), F.min_by("r", "__i").alias("r0"))
    chain = W.partitionBy("symbol").orderBy("__seg")
    steps = steps.withColumn("__nth", F.row_number().over(chain)).withColumn("__most", F.count("*").over(W.partitionBy("symbol")))
    most = steps.agg(F.max("__most")).first()[0] or 1
    factor = F.pow(F.lit(lam), F.col("m"))
    start = F.when(F.col("__nth") == 1, F.col("r0") * F.col("r0")).otherwise(0.0)
    steps = steps.select("symbol", "__seg", start.alias("start"), factor.alias("a"), (factor * (F.col("s") + start)).alias("b"))
    for k in range((most - 1).bit_length()):
        before = lambda c: F.lag(c, 1 << k).over(chain)  # noqa: B023, E731
        steps = steps.withColumns({"__pa": before("a"), "__pb": before("b")})
        steps = steps.select("symbol", "__seg", "start", F.coalesce(F.col("a") * F.col("__pa"), F.col("a")).alias("a"), F.coalesce(F.col("a") * F.col("__pb") + F.col("b"), F.col("b")).alias("b"))
    ends = steps.select("symbol", "__seg", (F.coalesce(F.lag("b").over(chain), F.lit(0.0)) + F.col("start")).alias("__h0"))
    d = d.join(ends, ["symbol", "__seg"])
    scaled = F.sum(weighted).over(own.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(out, F.pow(F.lit(lam), F.col("__i")) * (F.col("__h0") + scaled)).drop("__seg", "__i", "__h0")


def parkinson(df: DataFrame, n: int, least: int = 5, seconds: int = 60, out: str = "parkinson") -> DataFrame:
    x = F.when((F.col("high") > 0) & (F.col("low") > 0) & (F.col("high") >= F.col("low")), F.pow(F.log(F.col("high") / F.col("low")), 2))
    w = by_symbol().rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count(x).over(w) >= least, F.sqrt(F.avg(x).over(w) / (4 * math.log(2))) * math.sqrt(YEAR_S / seconds)))


def garman_klass(df: DataFrame, n: int = 60, least: int = 5, seconds: int = 60, out: str = "garman_klass") -> DataFrame:
    hl, co = F.log(F.col("high") / F.col("low")), F.log(F.col("close") / F.col("open"))
    x = F.when((F.col("low") > 0) & (F.col("open") > 0), 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co)
    w = by_symbol().rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count(x).over(w) >= least, F.sqrt(F.greatest(F.avg(x).over(w), F.lit(0.0))) * math.sqrt(YEAR_S / seconds)))


def hour_factors(df: DataFrame, value: str) -> DataFrame:
    """Each hour's median over the mean of the medians."""
    g = df.groupBy("symbol", F.pmod(F.floor(F.col("bar") / 60), F.lit(24)).cast("int").alias("hour")).agg(F.percentile(value, 0.5).alias("med"))
    return g.withColumn("factor", F.col("med") / F.avg("med").over(W.partitionBy("symbol"))).drop("med")


def seasonal(df: DataFrame, factors: DataFrame, base: str, out: str = "seasonal") -> DataFrame:
    d = df.withColumn("hour", F.pmod(F.floor(F.col("bar") / 60), F.lit(24)).cast("int"))
    return d.join(factors, ["symbol", "hour"], "left").withColumn(out, F.col(base) * F.coalesce("factor", F.lit(1.0))).drop("factor")


def intensity(df: DataFrame, base: str, out: str = "intensity") -> DataFrame:
    """base times the root of the bar's number of ticks over the symbol's median number."""
    med = df.groupBy("symbol").agg(F.percentile("n_ticks", 0.5).alias("__med"))
    return df.join(med, "symbol").withColumn(out, F.col(base) * F.sqrt(F.greatest("n_ticks", F.lit(1)) / F.greatest("__med", F.lit(1.0)))).drop("__med")


def pct_rank_trailing(df: DataFrame, value: str, n: int = 1440, least: int = 30, out: str = "pct_rank") -> DataFrame:
    """Share of the last n values that are at most the row's own; 0.5 while there are fewer than `least`."""
    d = df.withColumn("__xs", F.collect_list(value).over(by_symbol().rowsBetween(-(n - 1), 0)))
    share = F.size(F.filter("__xs", lambda x: x <= F.col(value))) / F.size("__xs")
    return d.withColumn(out, F.when((F.size("__xs") >= least) & F.col(value).isNotNull(), share).otherwise(0.5)).drop("__xs")


GARCH_GRID = [(a, b) for a in (0.02, 0.05, 0.1, 0.15) for b in (0.7, 0.8, 0.85, 0.9, 0.93) if a + b < 0.999]


def garch11(df: DataFrame, chunk: int = 1440, least: int = 100, out: str = "garch_h") -> DataFrame:
    """Conditional variance of each return by a variance-targeted grid of (alpha, beta), fitted on chunks of bars that overlap by half.

    A row is in two chunks and keeps the later one's value; chunks of fewer than `least` rows are not fitted, and rows of no fitted chunk
    go. A chunk is one task's group, of `chunk` rows at most; its recursion runs over all points of the grid at once.
    """
    import numpy as np
    import pandas as pd

    half = chunk // 2
    alpha, beta = (np.array(x) for x in zip(*GARCH_GRID))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("bar")
        r2, v = p["r"].to_numpy() ** 2, float(p["r"].var(ddof=0))
        if len(p) < least:
            return p[["symbol", "bar", "__c"]].iloc[:0].assign(**{out: pd.Series(dtype="float64")})
        best = np.full(len(r2), v)
        if v > 0:
            h, last = np.empty((len(r2), len(alpha))), np.full(len(alpha), v)
            for i, x in enumerate(r2):
                h[i] = last
                last = v * (1 - alpha - beta) + alpha * x + beta * last
            best = h[:, int(np.argmin((np.log(h) + r2[:, None] / h).sum(0)))]
        return pd.DataFrame({"symbol": p["symbol"], "bar": p["bar"], "__c": p["__c"], out: best})

    at = F.floor(F.col("bar") / half).cast("bigint")
    d = df.where("r is not null").select("symbol", "bar", "r", F.explode(F.array(at - 1, at)).alias("__c"))
    fits = d.groupBy("symbol", "__c").applyInPandas(fit, f"symbol string, bar bigint, __c bigint, {out} double")
    return fits.groupBy("symbol", "bar").agg(F.max_by(out, "__c").alias(out))


def ret_over(left: DataFrame, ticks: DataFrame, seconds: list[int], width: int = 3600 * NS, name: str = "ret") -> DataFrame:
    """Each row's symbol's return over the last s seconds; 0 where a price is missing."""
    d = asof_backward(left, ticks, "t_ns", ["symbol"], {"__now": "mid"}, width=width, tie=["mid"])
    for s in seconds:
        d = asof_backward(d, ticks, "t_ns", ["symbol"], {f"__p{s}": "mid"}, width=width, tie=["mid"], shift=-s * NS)
    out = d.select(*left.columns, *[F.coalesce(F.col("__now") / F.nullif(F.col(f"__p{s}"), F.lit(0.0)) - 1, F.lit(0.0)).alias(f"{name}_{s}s") for s in seconds])
    if 1 in seconds and 5 in seconds:
        out = out.withColumn("momentum_aligned", F.signum(f"{name}_1s") == F.signum(f"{name}_5s"))
    return out


def cross_asset_ret(left: DataFrame, ticks: DataFrame, lead_symbol: str, seconds: int, width: int = 3600 * NS) -> DataFrame:
    lead = left.withColumn("__own", F.col("symbol")).withColumn("symbol", F.lit(lead_symbol))
    out = ret_over(lead, ticks.where(F.col("symbol") == lead_symbol), [seconds], width, "lead_ret")
    return out.withColumn("symbol", F.col("__own")).drop("__own")


def taker_flow(trades: DataFrame, seconds: int, out: str = "flow") -> DataFrame:
    """Signed size of the last N seconds of the token."""
    w = W.partitionBy("token_id").orderBy("t_ns").rangeBetween(-seconds * NS, 0)
    return trades.withColumn(out, F.sum("signed_size").over(w))


def rolling_hours(slots: DataFrame, hours: int, value: str = "net") -> DataFrame:
    """Trailing sums over a dense axis of hours, where an hour without rows counts 0, with z-score and percentile in the history."""
    span = slots.agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    axis = span.select(F.explode(F.sequence("a", "b")).alias("slot"))
    d = axis.join(slots, "slot", "left").select("slot", F.coalesce(value, F.lit(0.0)).alias(value))
    d = d.withColumn("rolling", F.sum(value).over(W.orderBy("slot").rangeBetween(-(hours - 1), 0)))  # a row an hour
    everything = W.partitionBy(F.lit(1))
    return d.withColumns({"z": F.try_divide(F.col("rolling") - F.avg("rolling").over(everything), F.stddev_pop("rolling").over(everything)), "pctile": F.cume_dist().over(W.orderBy("rolling"))})


def lag_autocorr(df: DataFrame, value: str, lags: int, by: list[str], order: list[str]) -> DataFrame:
    """Pearson correlation with each lag, and whether it is beyond 1.96/sqrt(n). Keys are series of bounded length."""
    w = W.partitionBy(*by).orderBy(*order)
    d = df.withColumn("__ys", F.array(*[F.lag(value, k).over(w) for k in range(1, lags + 1)]))
    d = d.select(*by, F.col(value).alias("__x"), F.posexplode("__ys").alias("k", "__y"))
    g = d.where("__x is not null and __y is not null").groupBy(*by, (F.col("k") + 1).alias("lag")).agg(F.corr("__x", "__y").alias("acf"), F.count("*").alias("n"))
    return g.withColumn("significant", F.abs("acf") > 1.96 / F.sqrt("n"))


def session_split(events: DataFrame, gap_s: int, by: str = "service") -> DataFrame:
    """Runs of events less than gap_s apart: session number, start, end, events."""
    w = W.partitionBy(by).orderBy("t_ns")
    d = events.withColumn("__new", F.coalesce((F.col("t_ns") - F.lag("t_ns").over(w) > gap_s * NS).cast("int"), F.lit(1)))
    d = d.withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(by, "session").agg(F.min("t_ns").alias("start_ns"), F.max("t_ns").alias("end_ns"), F.count("*").alias("n"))


def corr_by(df: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(x, y).alias("corr"), F.count("*").alias("n")).where(F.col("n") >= least)


def corr_by_bucket(df: DataFrame, x: str, y: str, hours: int = 6) -> DataFrame:
    """Correlation of each bucket of hours, then mean, spread and their ratio by symbol."""
    b = df.groupBy("symbol", F.floor(F.col("bar") / (60 * hours)).alias("bucket")).agg(F.corr(x, y).alias("c"), F.count("*").alias("n")).where("n >= 5 and c is not null and not isnan(c)")
    return b.groupBy("symbol").agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.count("*").alias("buckets")).withColumn("cv", F.try_divide(F.col("std"), F.abs("mean")))


def variance_ratio(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.try_divide(F.var_pop(F.col(x) - F.col(y)), F.var_pop(y)).alias("ratio"))
