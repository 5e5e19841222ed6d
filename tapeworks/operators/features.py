"""Feature rows at quote time: spot returns, fair value, implied volatility and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import pricing as P
from . import levels as L
from .ordered import asof_backward, asof_nearest
from .volatility import cross_asset_ret, ewma_series, log_returns, pct_rank_trailing, ret_over, rv_rows

NS = M.NS
YEAR_S = P.YEAR_S


def with_strike(markets: DataFrame, ticks: DataFrame, width: int = 3600 * NS) -> DataFrame:
    """Each market's strike: the mid of its symbol nearest to its start."""
    return asof_nearest(markets, ticks.withColumnRenamed("t_ns", "__tt"), "start_ns", ["symbol"], {"strike": "mid"}, right_on="__tt", width=width, tie=["mid"])


def implied_sigma_at_post(fills: DataFrame, levels: DataFrame, ticks: DataFrame, max_lag_ns: int, width: int = 3600 * NS) -> DataFrame:
    """Volatility implied by each token's first fill as of the time its quote was posted.

    fills: token_id, price (number), level_price, side, t_ns, symbol, strike, tte_s. The time to expiry at the post is that at
    the fill and the lag.
    """
    first = fills.groupBy("token_id").agg(F.min_by(F.struct("symbol", "strike", "tte_s", F.col("price").alias("p")), F.struct("t_ns", "price")).alias("f"))
    at = L.quote_post_time(fills.select("token_id", F.col("level_price").alias("price"), "side", "t_ns"), levels, max_lag_ns)
    q = at.join(first, "token_id").select("token_id", F.col("t_post_ns").alias("t_ns"), "lag_s", "f.*")
    q = asof_nearest(q, ticks, "t_ns", ["symbol"], {"spot": "mid"}, width=width, tie=["mid"])
    tau = (F.col("tte_s") + F.col("lag_s")) / YEAR_S
    sigma, reason = P.implied_sigma(F.col("p"), F.col("strike"), F.col("spot"), tau)
    return q.select("token_id", "t_ns", "lag_s", "spot", sigma.alias("sigma"), reason.alias("reason"))


def quote_features(quotes: DataFrame, ticks: DataFrame, lead_symbol: str, sigma: float, seconds: tuple[int, ...] = (1, 5, 30, 60, 300), width: int = 3600 * NS) -> DataFrame:
    """quotes (quote_id, t_ns, symbol, strike, tte_s, n) with returns of its symbol and of the lead, fair value, distances and time parts."""
    q = ret_over(quotes, ticks, list(seconds), width)
    q = cross_asset_ret(q, ticks, lead_symbol, seconds[-1], width)
    q = asof_backward(q, ticks, "t_ns", ["symbol"], {"spot": "mid"}, width=width, tie=["mid"])
    tau = F.col("tte_s") / YEAR_S
    q = q.withColumns({f"abs_ret_{s}s": F.abs(f"ret_{s}s") for s in seconds})
    q = q.withColumns({"fair": P.fair_value_up(F.col("strike"), F.col("spot"), tau, F.lit(sigma)), "hour": M.hour_utc(F.col("t_ns")), "dow": M.day_of_week(F.col("t_ns"))})
    return q.withColumns(M.dist_features(tau, F.lit(sigma), F.col("spot"), F.col("strike"), F.lit(0.0), F.col("n")))


def open_volatility(markets: DataFrame, bars: DataFrame, seconds: int, lam: float = 0.94, spans: tuple[int, ...] = (5, 30), ranked: int = 30, least: int = 10, width: int = 30 * 86400 * NS) -> DataFrame:
    """markets (symbol, start_ns, ...) with their symbol's volatility as of their start: EWMA variance of a bar, realised volatility over some
    spans of bars, and the share of the last `ranked` EWMA values that are at most the latest. Null before a symbol's second bar."""
    b = ewma_series(log_returns(bars), lam, 240, "ewma_var")
    for n in spans:
        b = rv_rows(b, n, seconds, f"rv_{n}")
    b = pct_rank_trailing(b, "ewma_var", ranked, least, "ewma_rank")
    names = ["ewma_var", *[f"rv_{n}" for n in spans], "ewma_rank"]
    return asof_backward(markets, b.select("symbol", "t_ns", *names), "start_ns", ["symbol"], {n: n for n in names}, right_on="t_ns", width=width)
