"""How well a simulated account's fills match the real ones: counts and results by hour, shares, position paths, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordered import HOUR_NS, _bucket
from .regress import ks_distance

HOUR = 3600 * 1_000_000_000
#: Largest gaps that count as a match; for the correlation the least value.
TARGETS = {"fills": 0.20, "hourly_fills": 0.20, "pnl": 0.10, "hourly_pnl": 0.10, "maker_share": 0.05, "win_rate": 0.05, "position_pearson": 0.7, "fill_time_ks": 0.1}


def aligned_paths(a: DataFrame, b: DataFrame, by: str = "token_id", time: str = "t_ns", step: str = "signed_size", width: int = HOUR_NS, share: float = 0.005) -> DataFrame:
    """(by, time, until, x, y): both sides' positions from each time at which either changes to the next one of the key.

    The two step functions meet on the union of their times; a key's last position has no end and is left out, and where one side has
    not begun its position is 0. Keys that may hold over `share` of the rows are dealt by buckets of time, others are whole; a row for each
    key and bucket carries what comes before and the next bucket's first time. The rows themselves are shuffled once.
    """
    kind = a.schema[by].dataType
    u = a.select(by, time, F.col(step).alias("__x"), F.lit(0.0).alias("__y")).union(b.select(by, time, F.lit(0.0), F.col(step))).where(F.col(time).isNotNull())
    large = [v for v in u.select(F.col(by).cast("string").alias("k")).freqItems(["k"], share).first()[0] if v is not None]  # at most 1 / share, none is missed
    u = u.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("__k"), F.col(by).isNull().alias("__null"), time, "__x", "__y")
    u = u.withColumn("__b", F.when(F.col("__k").isin(large) | F.col("__null"), F.coalesce(_bucket(F.col(time), width), F.lit(0))).otherwise(F.lit(0).cast("bigint")))  # never null, so that both readers below share a shuffle
    at = ["__k", "__null", "__b"]
    u = u.repartition(*at).groupBy(*at, time).agg(F.sum("__x").alias("__x"), F.sum("__y").alias("__y"))
    buckets = W.partitionBy("__k", "__null").orderBy("__b")
    before = lambda c: F.coalesce(F.sum(c).over(buckets.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ends = u.groupBy(*at).agg(F.sum("__x").alias("__x"), F.sum("__y").alias("__y"), F.min(time).alias("__t"))
    ends = ends.select(*at, before("__x").alias("__x0"), before("__y").alias("__y0"), F.lead("__t").over(buckets).alias("__t1"))
    inside = W.partitionBy(*at).orderBy(time)
    run = lambda c: F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, 0))
    d = u.select(*at, time, run("__x").alias("__x"), run("__y").alias("__y"), F.lead(time).over(inside).alias("__t")).join(ends, at)
    d = d.select(F.when(~F.col("__null"), F.col("__k")).cast(kind).alias(by), time, F.coalesce("__t", "__t1").alias("until"), (F.col("__x0") + F.col("__x")).alias("x"), (F.col("__y0") + F.col("__y")).alias("y"))
    return d.where("until is not null")


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Pearson correlation of rows that count w each; null if either side never changes."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) / n - sx / n * sy / n
    spread = lambda v, s: F.greatest(F.sum(w * v * v) / n - s / n * s / n, F.lit(0.0))
    return F.try_divide(cov, F.sqrt(spread(x, sx) * spread(y, sy)))


def match_metrics(real: DataFrame, twin: DataFrame, width: int = HOUR_NS) -> DataFrame:
    """(metric, real, twin, gap, target, passed) of two sets of fills: token_id, t_ns, signed_size, is_maker, net, won (null while open).

    Hourly gaps are the sum over hours of absolute differences over the real side's sum of absolute values, an hour without fills counting
    0; other gaps are relative (fills, pnl) or differences (shares). A metric that has no value is not passed.
    """
    one = lambda d: d.agg(F.count("*").cast("double").alias("fills"), F.sum("net").alias("pnl"), F.avg(F.col("is_maker").cast("int")).alias("maker_share"), F.avg(F.col("won").cast("int")).alias("win_rate"))
    hourly = lambda d, s: d.groupBy(F.floor(F.col("t_ns") / HOUR).alias("hour")).agg(F.count("*").alias(f"n_{s}"), F.sum("net").alias(f"p_{s}"))
    h = hourly(real, "r").join(hourly(twin, "t"), "hour", "full").na.fill(0)
    gap = lambda c: F.try_divide(F.sum(F.abs(F.col(f"{c}_t") - F.col(f"{c}_r"))), F.sum(F.abs(F.col(f"{c}_r"))))
    hours = h.agg(gap("n").alias("hn"), gap("p").alias("hp"), F.sum(F.abs("p_r")).alias("hpr"), F.sum(F.abs("p_t")).alias("hpt"))
    paths = aligned_paths(real, twin, width=width)
    path = paths.agg(weighted_corr(F.col("x"), F.col("y"), ((F.col("until") - F.col("t_ns")) / 1e9)).alias("corr"))
    ks = ks_distance(real, twin, "t_ns")
    r, t = one(real).select(F.struct("*").alias("r")), one(twin).select(F.struct("*").alias("t"))
    all_ = r
    for other in (t, hours, path, ks):
        all_ = all_.crossJoin(F.broadcast(other))  # one row each
    relative = lambda c: F.try_divide(F.abs(F.col(f"t.{c}") - F.col(f"r.{c}")), F.abs(F.col(f"r.{c}")))
    none = F.lit(None).cast("double")
    rows = [("fills", F.col("r.fills"), F.col("t.fills"), relative("fills")), ("hourly_fills", F.col("r.fills"), F.col("t.fills"), F.col("hn")), ("pnl", F.col("r.pnl"), F.col("t.pnl"), relative("pnl")), ("hourly_pnl", F.col("hpr"), F.col("hpt"), F.col("hp"))]
    rows += [(c, F.col(f"r.{c}"), F.col(f"t.{c}"), F.abs(F.col(f"t.{c}") - F.col(f"r.{c}"))) for c in ("maker_share", "win_rate")]
    rows += [("position_pearson", none, none, F.col("corr")), ("fill_time_ks", none, none, F.col("ks"))]
    packed = [F.struct(F.lit(n).alias("metric"), a.cast("double").alias("real"), b.cast("double").alias("twin"), g.cast("double").alias("gap"), F.lit(TARGETS[n]).alias("target")) for n, a, b, g in rows]
    out = all_.select(F.explode(F.array(*packed)).alias("m")).select("m.*")
    ok = F.when(F.col("metric") == "position_pearson", F.col("gap") > F.col("target")).otherwise(F.col("gap") <= F.col("target"))
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))
