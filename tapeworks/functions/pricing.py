"""Fair value of a binary option and what its price implies, as columns. Invalid inputs give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_S = 365.25 * 86400

# Published coefficients of Hart's (1968) double-precision rational approximation of the normal distribution.
HART_N = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
HART_D = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)
# Published coefficients of Acklam's (2003) rational approximation of the inverse.
ACKLAM_A = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
ACKLAM_B = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877197, -13.2806815528857, 1.0)
ACKLAM_C = (-0.00778489400243029, -0.322396458041136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
ACKLAM_D = (0.00778469570904146, 0.32246712907004, 2.445134137143, 3.75440866190742, 1.0)


def _poly(x: Column, coefficients) -> Column:
    """Highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's argument is a variable, so large expressions don't multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_cdf(x: Column) -> Column:
    def below(a):
        tail = F.exp(-a * a / 2)
        inner = tail * _poly(a, HART_N[::-1]) / _poly(a, HART_D[::-1])
        fraction = a + F.lit(0.65)
        for k in (4, 3, 2, 1):
            fraction = a + F.lit(float(k)) / fraction
        return F.when(a > 37, 0.0).when(a < 7.07106781186547, inner).otherwise(tail / fraction / F.lit(2.506628274631))

    return let(x, lambda v: let(let(F.abs(v), below), lambda p: F.when(v > 0, 1 - p).otherwise(p)))


def norm_ppf(p: Column) -> Column:
    """One Newton step after the approximation brings it to double precision."""

    def rough(v):
        tail = lambda q: let(F.sqrt(-2 * F.log(q)), lambda t: _poly(t, ACKLAM_C) / _poly(t, ACKLAM_D))
        middle = let(v - 0.5, lambda q: q * let(q * q, lambda r: _poly(r, ACKLAM_A) / _poly(r, ACKLAM_B)))
        return F.when(v < 0.02425, tail(v)).when(v > 1 - 0.02425, -tail(1 - v)).otherwise(middle)

    def refined(v):
        step = lambda x: let((norm_cdf(x) - v) * F.sqrt(F.lit(6.283185307179586)) * F.exp(x * x / 2), lambda e: x - e / (1 + x * e / 2))
        return F.when((v > 0) & (v < 1), let(rough(v), step))

    return let(p, refined)


def fair_value_up(strike: Column, spot: Column, tau: Column, sigma: Column) -> Column:
    ok = (strike > 0) & (spot > 0) & (tau > 0) & (sigma > 0)
    return F.when(ok, norm_cdf(-F.log(strike / spot) / (sigma * F.sqrt(tau))))


def implied_sigma(price: Column, strike: Column, spot: Column, tau: Column) -> tuple[Column, Column]:
    """(sigma, reason): closed form, or null with the reason for dropping the row."""
    move = F.log(F.try_divide(strike, spot))
    sigma = F.try_divide(move, F.sqrt(tau) * norm_ppf(1 - price))
    reason = (
        F.when(~((strike > 0) & (spot > 0)) | strike.isNull() | spot.isNull(), "no_spot")
        .when(~(tau > 0) | tau.isNull(), "no_time")
        .when((price < 0.02) | (price > 0.98), "price_edge")
        .when(F.abs(price - 0.5) < 0.02, "price_atm")
        .when(F.abs(move) < 1e-4, "spot_atm")
        .when((sigma <= 0) | (sigma > 15) | sigma.isNull() | F.isnan(sigma), "sigma_range")
    )
    return F.when(reason.isNull(), sigma), F.coalesce(reason, F.lit("ok"))


def implied_sigma_bounded(price: Column, strike: Column, spot: Column, tau: Column, low: float = 1e-6, high: float = 10.0) -> Column:
    """The root in (low, high), from the closed form; null where there is none."""
    ok = (price > 0) & (price < 1) & (tau > 0) & (strike > 0) & (spot > 0) & (F.abs(price - 0.5) > 1e-12)
    sigma = F.try_divide(F.log(F.try_divide(strike, spot)), F.sqrt(tau) * -norm_ppf(price))
    return F.when(ok & (sigma > low) & (sigma < high), sigma)


def quote_model(fair: Column, direction: Column, sigma_tau: Column, h0: float, h1: float, rho: float, c0: float, c1: float) -> Column:
    q = fair - direction * (F.lit(h0) + F.lit(h1) * sigma_tau) + F.lit(rho) * (0.5 - F.least(fair, 1 - fair)) + F.lit(c0) + F.lit(c1) * sigma_tau
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), q))


def residual(price: Column, fair: Column, half_spread: float) -> Column:
    return price - (fair + F.when(price > fair, 1).otherwise(-1) * F.lit(half_spread))


def half_spread_as(sigma: Column, tau: Column, gamma: float, kappa: float) -> Column:
    import math

    return F.lit(gamma) * sigma * sigma * tau / 2 + F.lit(math.log(1 + gamma / kappa) / gamma)


def inventory_skew(position: Column, sigma: Column, tau: Column, gamma: float) -> Column:
    return -F.lit(gamma) * position * sigma * sigma * tau


def rebate_shift(fair: Column, rho: float) -> Column:
    return F.lit(rho) * (0.5 - F.least(fair, 1 - fair))


def implied_spot(strike: Column, price: Column, tau: Column, sigma: Column) -> Column:
    return strike * F.exp(sigma * F.sqrt(tau) * norm_ppf(price))


def softmax(columns: list[Column]) -> list[Column]:
    top = F.greatest(*columns)
    exps = [F.exp(c - top) for c in columns]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]
