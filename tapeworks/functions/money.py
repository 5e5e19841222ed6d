"""Prices, amounts and times as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def num(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def norm_price(c: Column) -> Column:
    """Price text with six places, halves to even; what is no number stays as it is."""
    return F.coalesce(F.bround(c.try_cast("decimal(38,12)"), 6).cast("string"), c)


def dec6(c: Column) -> Column:
    """Six places, halves up, as a decimal."""
    return F.round(c.try_cast("decimal(38,12)"), 6).cast("decimal(38,6)")


def raw_to_units(c: Column, places: int = 6) -> Column:
    """An integer amount (text or number) over 10^places."""
    return (c.try_cast("decimal(38,0)") / F.lit(10**places).cast("decimal(20,0)")).cast("decimal(38,6)")


def ms_to_ns(c: Column) -> Column:
    return c.try_cast("bigint") * 1_000_000


def ns_to_timestamp(c: Column) -> Column:
    return F.timestamp_micros(F.floor(c / 1000).cast("bigint"))


def flag_backfilled(t_recv: Column, t_block: Column, seconds: int = 10) -> Column:
    return F.abs(t_recv - t_block) > seconds * NS


def account_side(side: Column) -> Column:
    """0: the account sells, 1: it buys."""
    return F.when(side == 0, "SELL").when(side == 1, "BUY")


def fill_price(side: Column, maker: Column, taker: Column) -> Column:
    return F.when(side == 0, F.try_divide(maker, taker)).when(side == 1, F.try_divide(taker, maker))


def fill_size(side: Column, maker: Column, taker: Column) -> Column:
    return F.when(side == 0, taker).when(side == 1, maker)


def maker_rebate(is_maker: Column, price: Column, size: Column, share: float = 0.2, rate: float = 0.07) -> Column:
    return F.when(is_maker, F.lit(share * rate) * F.least(price, 1 - price) * size).otherwise(0.0)


def time_to_expiry_s(end_unix: Column, t_ns: Column) -> Column:
    return end_unix - t_ns / NS


def canonical_sign(side: Column, outcome: Column) -> Column:
    """+1 for long Up or short Down, -1 otherwise."""
    return F.when(((side == "BUY") & (outcome == "Up")) | ((side == "SELL") & (outcome == "Down")), 1).otherwise(-1)


def up_price(price: Column, outcome: Column) -> Column:
    return F.when(outcome == "Up", price).otherwise(1 - price)


def atm_displacement(up: Column) -> Column:
    return up - 0.5


def otm_cushion(up: Column) -> Column:
    return F.abs(up - 0.5)


def adverse_selection(up: Column, sign: Column) -> Column:
    return -(up - 0.5) * sign


def rebate_favoured(up: Column) -> Column:
    return F.when(up > 0.5, "Down").when(up < 0.5, "Up").otherwise("ATM")


def rebate_aligned(up: Column, outcome: Column) -> Column:
    return rebate_favoured(up) == outcome


def rebate_pct(rebate: Column, price: Column, size: Column) -> Column:
    return rebate / F.greatest(price * size, F.lit(1e-9))


def mtm_binary(sign: Column, up_wins: Column, up: Column, size: Column) -> Column:
    """Payout less price, in Up terms; null while unresolved."""
    return sign * (up_wins - up) * size


def mtm_spot(sign: Column, s_end: Column, strike: Column, up: Column, size: Column, tie_up: bool = False) -> Column:
    wins = F.when(s_end >= strike if tie_up else s_end > strike, 1.0).otherwise(0.0)
    return F.when(s_end.isNotNull() & (strike > 0), sign * (wins - up) * size)


def as_cost(sign: Column, s_fill: Column, s_post: Column, price: Column, size: Column) -> Column:
    return F.when(s_post > 0, sign * (s_fill / s_post - 1) * price * size)


def outcome_type(mean_sign: Column, up_wins: Column, band: float = 0.1) -> Column:
    """favourable: the market's net direction won; unfavourable: it lost; mixed: hardly any net direction."""
    return F.when(up_wins.isNull(), None).when(F.abs(mean_sign) < band, "mixed").when((mean_sign > 0) == (up_wins == 1), "favourable").otherwise("unfavourable")


def win_flags(sign: Column, up_wins: Column) -> dict[str, Column]:
    return {"long_won": (sign == 1) & (up_wins == 1), "long_lost": (sign == 1) & (up_wins == 0), "short_won": (sign == -1) & (up_wins == 0), "short_lost": (sign == -1) & (up_wins == 1)}


def hour_utc(t_ns: Column) -> Column:
    return F.pmod(F.floor(t_ns / (3600 * NS)), F.lit(24)).cast("int")


def day_index(t_ns: Column) -> Column:
    return F.floor(t_ns / (86400 * NS)).cast("bigint")


def day_of_week(t_ns: Column, shift: int = 3) -> Column:
    """0: Monday, with the shift of 3 that 1970-01-01 (a Thursday) asks for."""
    return F.pmod(day_index(t_ns) + shift, F.lit(7)).cast("int")


def bucket(t_ns: Column, seconds: int) -> Column:
    return F.floor(t_ns / (seconds * NS)).cast("bigint")


HORIZON_SECONDS = {"5m": 300, "15m": 900, "1h": 3600, "4h": 14400}


def coded(c: Column, codes: dict[str, int], other: int = -1) -> Column:
    """A label's number, `other` for those without one."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[c], F.lit(other))


def horizon_seconds(c: Column) -> Column:
    return coded(c, HORIZON_SECONDS)


def asset_prefix_filter(slug: Column, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(slug).startswith(n.lower()) for n in names])


def market_eligible(accepting: Column, neg_risk: Column, end_text: Column, now: Column, hours: int = 6) -> Column:
    end = F.try_to_timestamp(F.replace(end_text, F.lit("Z"), F.lit("+00:00")))
    return F.coalesce(accepting & ~F.coalesce(neg_risk, F.lit(False)) & (end > now) & (end <= now + F.make_dt_interval(hours=F.lit(hours))), F.lit(False))


def spot_proximity(spot: Column, strike: Column, tte_s: Column, within_s: float = 60) -> Column:
    return F.when((tte_s < within_s) & (strike > 0), F.abs(spot - strike) / strike)


def dist_features(tau: Column, sigma: Column, spot: Column, strike: Column, lag: Column, n: Column) -> dict[str, Column]:
    return {"log_tau": F.log(tau), "sqrt_tau": F.sqrt(tau), "sigma_sqrt_tau": sigma * F.sqrt(tau), "abs_log_move": F.abs(F.log(spot / strike)), "log_strike": F.log(strike), "log1p_lag": F.log1p(lag), "log1p_n": F.log1p(n)}


def word_unsigned(hexed: Column, index: int) -> Column:
    """The 32-byte word at `index` of hex data (without 0x), as decimal text of any size.

    Words below 2^64 are one conversion, those below 2^124 one decimal of two; larger ones take base 10^9 limbs folded over 8-digit chunks.
    """
    word = F.substring(hexed, 64 * index + 1, 64)
    half = lambda at, n: F.conv(F.substring(hexed, 64 * index + at, n), 16, 10).cast("decimal(20,0)")
    small = (half(34, 15) * F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(38,0)") + half(49, 16)
    chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(word.substr(k * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    zero = F.array_repeat(F.lit(0).cast("bigint"), 9)

    def push(limbs, chunk):
        # limbs * 2^32 + chunk, least limb first; each step carries into the next limb
        start = F.struct(F.array().cast("array<bigint>").alias("out"), chunk.alias("carry"))

        def step(acc, limb):
            v = limb * F.lit(4294967296) + acc["carry"]
            return F.struct(F.array_append(acc["out"], v % 1000000000).alias("out"), F.floor(v / 1000000000).cast("bigint").alias("carry"))

        return F.aggregate(limbs, start, step)["out"]

    limbs = F.aggregate(chunks, zero, push)
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    large = F.coalesce(F.nullif(F.regexp_replace(text, "^0+", ""), F.lit("")), F.lit("0"))
    tiny = F.conv(F.substring(hexed, 64 * index + 49, 16), 16, 10)
    return F.when(F.length(word) == 64, F.when(word.startswith("0" * 48), tiny).when(word.startswith("0" * 33), small.cast("decimal(38,0)").cast("string")).otherwise(large))
