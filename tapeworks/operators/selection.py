"""Exact percentiles by distributed selection, and bootstraps whose rounds share one pass.

Doubles are rounded to 10, to 31 and to all 53 bits, each of which keeps their order. Counts by the first tell which of these
buckets hold the wanted ranks; only rows of those are counted by the second, and so on. What is shuffled are counts; a bucket
has at most four million below it, so no task holds a table's values, whatever their distribution.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LEVELS = ("__l1", "__l2", "__l3")


def order_parts(v: Column) -> list[Column]:
    """v rounded to 10 and to 31 bits (and scaled, so that nothing overflows), and v: each is monotone in v."""
    s = v * 2.0**-60

    def rounded(bits: int) -> Column:
        c = s * (2.0 ** (53 - bits) + 1)
        return F.when(F.abs(v) == float("inf"), v).otherwise(c - (c - s))

    return [rounded(10), rounded(31), v]


def _ranks(total: Column, ps: dict[str, float]) -> Column:
    """The two neighbouring ranks (from 0) of each percentile by linear interpolation, and the share of the upper one."""
    at = {n: F.lit(float(p)) * (total - 1) for n, p in ps.items()}
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(up).alias("up"), (F.ceil(x) if up else F.floor(x)).cast("bigint").alias("r"), (x - F.floor(x)).cast("double").alias("frac")) for n, x in at.items() for up in (False, True)])


def _equal(a: DataFrame, b: DataFrame, names: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[prefix + c])
    return on


def selected(counts: Callable[[int, DataFrame | None], DataFrame], by: list[str], ps: dict[str, float], small: bool) -> DataFrame:
    """(by, name, value): percentiles from histograms.

    counts(level, prefixes): (by, parts up to the level, c, v) for the rows whose parts up to the level before are in prefixes
    (distinct; None for all); v is a value of the bucket. small: prefixes are a few rows, so they are broadcast.
    """
    wanted = None
    for level in range(3):
        known, part = list(LEVELS[:level]), LEVELS[level]
        hint = (lambda x: F.broadcast(x)) if small else (lambda x: x)  # two rows for each percentile
        h = counts(level, None if wanted is None else hint(wanted.select(*by, *known).distinct()))
        w = W.partitionBy(*by, *known)
        h = h.withColumn("__before", F.sum("c").over(w.orderBy(part)) - F.col("c"))
        if wanted is None:
            h = h.withColumn("__ranks", _ranks(F.sum("c").over(w), ps))
        else:
            ranks = wanted.groupBy(*by, *known).agg(F.collect_list("__x").alias("__ranks"))  # two for each percentile at most
            ranks = ranks.select(*[F.col(c).alias(f"__k{c}") for c in [*by, *known]], "__ranks")
            h = h.join(hint(ranks), _equal(h, ranks, [*by, *known], "__k"))
        inside = F.filter("__ranks", lambda x: (x["r"] >= F.col("__before")) & (x["r"] < F.col("__before") + F.col("c")))
        hit = h.select(*by, *known, part, "v", "__before", F.explode(inside).alias("__y"))
        wanted = hit.select(*by, *known, part, "v", F.struct("__y.name", "__y.up", (F.col("__y.r") - F.col("__before")).alias("r"), "__y.frac").alias("__x"))
    low, high = F.max(F.when(~F.col("__x.up"), F.col("v"))), F.max(F.when(F.col("__x.up"), F.col("v")))
    frac = F.max("__x.frac")
    value = F.when(frac == 0, low).otherwise(low + frac * (high - low))
    return wanted.groupBy(*by, F.col("__x.name").alias("name")).agg(value.alias("value"))


def percentiles(df: DataFrame, value: str | Column, ps: dict[str, float], by: list[str] | None = None, weight: Column | None = None, accuracy: int | None = None) -> DataFrame:
    """A row for each group (one row without groups) with a column for each percentile, interpolated linearly.

    Nulls and NaN have no part; a group without values has no row, a table without values one row of nulls. weight: whole numbers,
    each row counts so often. accuracy: approximate ones instead (error 1/accuracy of the ranks), by one pass of sketches.
    """
    by = list(by or [])
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    d = df.select(*by, v.alias("__v"), (F.lit(1) if weight is None else weight).cast("bigint").alias("__w")).where("__v is not null and not isnan(__v) and __w > 0")
    if accuracy is not None:
        return d.groupBy(*by).agg(*[F.percentile_approx("__v", p, accuracy).alias(n) for n, p in ps.items()])
    d = d.select(*by, "__v", "__w", *[c.alias(n) for c, n in zip(order_parts(F.col("__v")), LEVELS)])

    def counts(level: int, prefixes: DataFrame | None) -> DataFrame:
        rows = d
        if prefixes is not None:
            p = prefixes.select(*[F.col(c).alias(f"__p{c}") for c in prefixes.columns])
            rows = d.join(p, _equal(d, p, prefixes.columns, "__p"), "left_semi")
        return rows.groupBy(*by, *LEVELS[: level + 1]).agg(F.sum("__w").alias("c"), F.max("__v").alias("v"))

    found = selected(counts, by, ps, small=not by)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ps])


def poisson_weights(keys: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """rows x rounds whole weights, Poisson with mean 1 (to 2^-16), from a hash of each row's key and the round: four rounds to a hash."""
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    table = np.searchsorted(cdf, (np.arange(1 << 16) + 0.5) / (1 << 16), "right").astype(np.uint8)
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(1, -(-rounds // 4) + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return table[x.astype("<u8").view("<u2")[:, :rounds]]


def bootstrap_medians(df: DataFrame, value: str, key: str, rounds: int, seed: int) -> DataFrame:
    """(round, median): of each round's Poisson bootstrap. A task sums the weights of all rounds by bucket before anything is shuffled."""
    import pyarrow as pa

    d = df.select(F.xxhash64(key).alias("__key"), F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    d = d.select("__key", "__v", *[c.alias(n) for c, n in zip(order_parts(F.col("__v")), LEVELS)])

    def counts(level: int, prefixes: DataFrame | None) -> DataFrame:
        parts, rows = list(LEVELS[: level + 1]), d
        if prefixes is not None:
            p = prefixes.select(*[F.col(c).alias(f"__p{c}") for c in parts[:-1]]).distinct()
            rows = d.join(F.broadcast(p), _equal(d, p, parts[:-1], "__p"), "left_semi")  # two for each round at most

        def summed(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                cols = [b.column(c).to_numpy() for c in parts]
                order = np.lexsort(cols[::-1])
                cols, w = [c[order] for c in cols], poisson_weights(b.column("__key").to_numpy(), rounds, seed)[order]
                cut = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c[cut]) for c in cols], pa.array(np.maximum.reduceat(b.column("__v").to_numpy()[order], cut)), pa.array(list(np.add.reduceat(w, cut, axis=0, dtype=np.int64)), pa.list_(pa.int64()))], [*parts, "v", "w"])

        sums = rows.select("__key", "__v", *parts).mapInArrow(summed, ", ".join([*(f"{c} double" for c in parts), "v double", "w array<bigint>"]))
        each = sums.select(*parts, "v", F.posexplode("w").alias("round", "w")).where("w > 0")
        return each.groupBy("round", *parts).agg(F.sum("w").alias("c"), F.max("v").alias("v"))

    found = selected(counts, ["round"], {"median": 0.5}, small=True)  # rounds are a parameter
    return found.select((F.col("round") + 1).alias("round"), F.col("value").alias("median"))


def bootstrap_ci(df: DataFrame, value: str, key: str, rounds: int = 200, seed: int = 42, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Poisson bootstrap of the median: one row with percentiles over the rounds' exact medians. Equal keys share their weights."""
    m = bootstrap_medians(df, value, key, rounds, seed)  # a row a round
    return m.agg(F.percentile("median", lo).alias("lo"), F.percentile("median", 0.5).alias("mid"), F.percentile("median", hi).alias("hi"), F.count("*").alias("rounds"))


def bootstrap_moments(df: DataFrame, y: str, x: str, key: str, rounds: int, seed: int) -> DataFrame:
    """(round, n, sx, sy, sxx, sxy, syy): weighted sums of products of each round, and of round 0, where each row counts once.

    A task adds up all rounds as one product of matrices, and what is shuffled is a row for each task and round.
    """
    import pyarrow as pa

    d = df.select(F.xxhash64(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]

    def summed(batches):
        total = np.zeros((rounds + 1, len(names)))
        for b in batches:
            u, v = b.column("x").to_numpy(), b.column("y").to_numpy()
            rows = np.stack([np.ones(len(u)), u, v, u * u, u * v, v * v], axis=1)
            total[0] += rows.sum(0)
            for at in range(0, len(u), 1000):  # so that the weights fit a cache
                total[1:] += poisson_weights(b.column("k").to_numpy()[at : at + 1000], rounds, seed).T.astype(float) @ rows[at : at + 1000]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds + 1)), *[pa.array(total[:, i]) for i in range(len(names))]], ["round", *names])

    sums = d.mapInArrow(summed, ", ".join(["round bigint", *(f"{n} double" for n in names)]))
    return sums.groupBy("round").agg(*[F.sum(n).alias(n) for n in names])


def bias_regression(df: DataFrame, y: str, x: str, key: str, expected: dict[str, float], rounds: int = 2000, seed: int = 42, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """y on [1, x] with bootstrap intervals: term (const, x), coef, lo, hi, expected, and whether that is inside. rounds rows are all that is gathered."""
    m = bootstrap_moments(df, y, x, key, rounds, seed)
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fits = m.withColumn("slope", slope).withColumn("const", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    terms = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(c).alias("b"), F.lit(float(expected[t])).alias("expected")) for t, c in (("const", "const"), (x, "slope"))]))
    g = fits.select("round", "n", terms.alias("t")).select("round", "n", "t.*").groupBy("term", "expected")
    own, others = F.max(F.when(F.col("round") == 0, F.col("b"))), F.when(F.col("round") > 0, F.col("b"))
    out = g.agg(own.alias("coef"), F.percentile(others, lo).alias("lo"), F.percentile(others, hi).alias("hi"), F.max(F.when(F.col("round") == 0, F.col("n"))).cast("bigint").alias("n"))
    return out.select("term", "coef", "lo", "hi", "expected", F.col("expected").between(F.col("lo"), F.col("hi")).alias("inside"), "n")
