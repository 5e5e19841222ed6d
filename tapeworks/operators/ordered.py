"""As-of joins, running sums and other operators over time, in two levels.

A symbol can hold a third of all rows, so no window runs over a whole symbol. Rows are dealt by (keys, bucket of time); what a
bucket must know of earlier ones (a total, a last value) comes from a table with a row for each key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOUR_NS = 3600 * 1_000_000_000


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / width).cast("bigint")


def running_sum(df: DataFrame, value: str, by: list[str], order: list[str], out: str, width: int, number: str | None = None) -> DataFrame:
    """Sum of `value` up to and with the row; `number`: a column for the row's number (from 1). order[0] is the number that buckets of `width` are cut from.

    What earlier buckets sum to is a row before a bucket's own, so that the rows are shuffled and sorted once.
    """
    d = df.where(F.col(order[0]).isNotNull()).withColumns({"__b": _bucket(F.col(order[0]), width), "__own": F.lit(True), "__c": F.lit(1).cast("bigint")})
    sums = d.groupBy(*by, "__b").agg(F.sum(value).alias("__s"), F.sum("__c").alias("__n"))
    earlier = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    heads = sums.select(*by, "__b", F.sum("__s").over(earlier).alias(value), F.sum("__n").over(earlier).alias("__c"), F.lit(False).alias("__own")).where("__c is not null")
    run = W.partitionBy(*by, "__b").orderBy("__own", *order).rowsBetween(W.unboundedPreceding, 0)
    d = d.unionByName(heads, allowMissingColumns=True).withColumns({"__run": F.sum(value).over(run)} | ({"__at": F.sum("__c").over(run)} if number else {})).where("__own")
    return d.select(*[c for c in df.columns if c not in (out, number)], F.col("__run").alias(out), *([F.col("__at").alias(number)] if number else []))


def _asof(left: DataFrame, right: DataFrame, l_time: Column, r_time: Column, by: list[str], take: dict[str, str], strict: bool, backward: bool, width: int, tie: list[str]) -> DataFrame:
    """left with the columns take (new name -> right's name) of the last right row at or before its time; forward: first at or after."""
    sign = 1 if backward else -1
    names = {f"__v{i}": src for i, src in enumerate(take.values())}
    l = left.select(F.struct("*").alias("__l"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], (l_time * sign).alias("__t"))  # noqa: E741
    packed = F.struct(*[F.col(src).alias(n) for n, src in names.items()])
    r = right.select(packed.alias("__r"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], (r_time * sign).alias("__t"), F.struct(*[F.col(c) for c in tie]).alias("__tie") if tie else F.lit(0).alias("__tie"))
    keys = [f"__k{i}" for i in range(len(by))]
    r = r.where(F.col("__t").isNotNull())
    lt = l.select("__l", F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), *keys, "__t", F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie"), F.lit(0 if strict else 1).alias("__o"))
    rt = r.select(F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), "__r", *keys, "__t", "__tie", F.lit(1 if strict else 0).alias("__o"))
    u = lt.union(rt).withColumn("__b", _bucket(F.col("__t"), width))
    ends = u.groupBy(*keys, "__b").agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__tie"))).alias("__last"))
    carry = F.last("__last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*[F.col(k).alias(f"{k}e") for k in keys], F.col("__b").alias("__be"), carry.alias("__carry"))
    cond = F.col("__b").eqNullSafe(F.col("__be"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}e"))
    seen = F.last("__r", ignorenulls=True).over(W.partitionBy(*keys, "__b").orderBy("__t", "__o", "__tie").rowsBetween(W.unboundedPreceding, 0))
    found = u.withColumn("__hit", seen).where(F.col("__l").isNotNull()).join(ends, cond).withColumn("__hit", F.coalesce("__hit", "__carry"))
    kept = [c for c in left.columns if c not in take]
    return found.select(*[F.col(f"__l.`{c}`").alias(c) for c in kept], *[F.col(f"__hit.{n}").alias(new) for n, new in zip(names, take)])


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: list[str], take: dict[str, str], right_on: str | None = None, strict: bool = False, width: int = HOUR_NS, tie: list[str] | None = None, shift: int = 0) -> DataFrame:
    """Last right row at or before left's time plus `shift` (strict: before it); nulls where there is none. Equal times: the last by `tie`."""
    return _asof(left, right, F.col(on) + shift, F.col(right_on or on), by, take, strict, True, width, tie or [])


def asof_forward(left: DataFrame, right: DataFrame, on: str, by: list[str], take: dict[str, str], right_on: str | None = None, strict: bool = False, width: int = HOUR_NS, tie: list[str] | None = None, shift: int = 0) -> DataFrame:
    """First right row at or after left's time plus `shift` (strict: after it). Equal times: the last by `tie`."""
    return _asof(left, right, F.col(on) + shift, F.col(right_on or on), by, take, strict, False, width, tie or [])


def latest_before(left, right, on, by, take, **options) -> DataFrame:
    return asof_backward(left, right, on, by, take, strict=True, **options)


def next_after(left, right, on, by, take, **options) -> DataFrame:
    return asof_forward(left, right, on, by, take, strict=True, **options)


def asof_nearest(left: DataFrame, right: DataFrame, on: str, by: list[str], take: dict[str, str], right_on: str | None = None, width: int = HOUR_NS, tie: list[str] | None = None) -> DataFrame:
    """The right row nearest in time; of two as near, the earlier."""
    right_on = right_on or on
    b = asof_backward(left, right, on, by, {**{f"__b_{n}": s for n, s in take.items()}, "__bt": right_on}, right_on, False, width, tie)
    f = asof_forward(b, right, on, by, {**{f"__f_{n}": s for n, s in take.items()}, "__ft": right_on}, right_on, False, width, tie)
    back = F.col("__ft").isNull() | (F.col(on) - F.col("__bt") <= F.col("__ft") - F.col(on))
    return f.select(*[c for c in left.columns if c not in take], *[F.when(back & F.col("__bt").isNotNull(), F.col(f"__b_{n}")).otherwise(F.col(f"__f_{n}")).alias(n) for n in take])


def asof_forward_clamped(left: DataFrame, right: DataFrame, on: str, by: list[str], take: dict[str, str], right_on: str | None = None, width: int = HOUR_NS, tie: list[str] | None = None) -> DataFrame:
    """First right row at or after; past the end, the key's last row."""
    f = asof_forward(left, right, on, by, {n: s for n, s in take.items()} | {"__ft": right_on or on}, right_on, False, width, tie)
    order = F.struct(right_on or on, *(tie or []))
    ends = right.groupBy(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(by)]).agg(*[F.max_by(s, order).alias(f"__end_{n}") for n, s in take.items()])
    if by:
        cond = F.col(by[0]).eqNullSafe(F.col("__e0"))
        for i, c in enumerate(by[1:], 1):
            cond = cond & F.col(c).eqNullSafe(F.col(f"__e{i}"))
        f = f.join(ends, cond, "left")
    else:
        f = f.crossJoin(F.broadcast(ends))  # one row
    return f.select(*[c for c in left.columns if c not in take], *[F.when(F.col("__ft").isNull(), F.col(f"__end_{n}")).otherwise(F.col(n)).alias(n) for n in take])


def match_within(left: DataFrame, right: DataFrame, on: str, by: list[str], tolerance: int, take: dict[str, str], right_on: str | None = None, **options) -> DataFrame:
    """The earliest right row of equal keys at most `tolerance` before or after; nulls where there is none."""
    right_on = right_on or on
    f = asof_forward(left, right, on, by, take | {"__mt": right_on}, right_on, shift=-tolerance, **options)
    near = F.col("__mt") <= F.col(on) + tolerance
    return f.select(*[c for c in left.columns if c not in take], *[F.when(near, F.col(n)).alias(n) for n in take])


def exists_within(left: DataFrame, right: DataFrame, on: str, by: list[str], lo: int, hi: int, out: str, right_on: str | None = None, **options) -> DataFrame:
    """Whether a right row of equal keys lies strictly between time + lo and time + hi."""
    right_on = right_on or on
    f = asof_forward(left, right, on, by, {"__xt": right_on}, right_on, strict=True, shift=lo, **options)
    return f.withColumn(out, F.coalesce(F.col("__xt") < F.col(on) + hi, F.lit(False))).drop("__xt")


def interval_overlap_count(df: DataFrame, by: list[str], start: str, end: str, out: str, width: int = HOUR_NS) -> DataFrame:
    """For each row, how many other intervals of its keys strictly contain its start: a sweep of +1 at starts and -1 at ends."""
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    none = F.lit(None).cast(df.select(F.struct("*").alias("r")).schema["r"].dataType)
    # at one time: ends close before starts ask, starts open after all have asked
    asks = df.select(F.struct("*").alias("__row"), *keys, F.col(start).alias("__t"), F.lit(1).alias("__o"), F.lit(0).alias("__d"))
    opens = df.where(F.col(start) < F.col(end)).select(none.alias("__row"), *keys, F.col(start).alias("__t"), F.lit(2).alias("__o"), F.lit(1).alias("__d"))
    closes = df.where(F.col(start) < F.col(end)).select(none.alias("__row"), *keys, F.col(end).alias("__t"), F.lit(0).alias("__o"), F.lit(-1).alias("__d"))
    swept = running_sum(asks.union(opens).union(closes), "__d", names, ["__t", "__o"], "__n", width)
    return swept.where(F.col("__row").isNotNull()).select("__row.*", F.col("__n").cast("bigint").alias(out))


def dedup_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, by a grouped minimum, which combines on the map side."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])
