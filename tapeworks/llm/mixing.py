"""Mixing sources to target weights along a curriculum, in DataFrame functions alone.

Each source has a target number of words (its weighted share, at most `most` times its size) and a schedule: how its demand
is spread over training time 0..1. Demand up to time t is the target times the schedule's integral. A document has a place in
its source's order (by the MD5 of its id), hence an offset in words; its training position is the time at which the source's
cumulative demand reaches that offset. Sources that need more words than they have run through their order again.

Offsets are prefix sums in two levels: sums of 4096 slices of each source, then within a slice. No source's rows meet in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import quoted

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: (time, relative weight) knots for sources of each weight: the heavy ones early, the light ones late; each has mean 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def inverse_demand(y: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear schedule, scaled to 1 in all, reaches y."""
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    y, out = y * F.lit(area[-1]), None
    for k in range(len(knots) - 2, -1, -1):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope, rest = (w1 - w0) / (t1 - t0), F.greatest(y - F.lit(area[k]), F.lit(0.0))
        step = rest / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        out = F.lit(t0) + step if out is None else F.when(y < F.lit(area[k + 1]), F.lit(t0) + step).otherwise(out)
    return out


def targets(sources: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """sources (source, source_size) -> with weight_no, target: all sizes shared by weight, none above `most` times its size.

    Sources by code point, null last, weigh in turn. The excess of those above their limit is reshared by weight until none
    is: with sources in order of limit over weight, a prefix is at its limit and the rest share what is left.
    """
    first = W.orderBy(F.col("source").asc_nulls_last())
    no = (F.row_number().over(first) - 1) % len(weights)
    s = sources.withColumn("weight_no", no).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("weight_no") + 1))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    everything = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    s = s.withColumn("level", (everything - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("full", F.min((F.col("level") * F.col("weight") >= F.col("cap")).cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    level = F.min_by(F.when(F.col("full") == 0, F.col("level")), F.when(F.col("full") == 0, F.struct("ratio", F.col("source").isNull(), "source"))).over(W.partitionBy(F.lit(1)))
    s = s.withColumn("shared", level)
    return s.select("source", "source_size", "weight_no", F.when(F.col("full") == 1, F.col("cap").cast("double")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def _plan(docs: DataFrame, keep: list[str], weights, schedules, most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs (columns `keep`) with __size, __source_size, __target, __taken and __positions."""
    text, source = F.col(text_col), F.col(source_col)
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    plan = {"__size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "__source": source, "__skey": key(source), "__id": F.col(id_col), "__order": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))}
    rows = docs.select(*quoted(keep), *[c.alias(n) for n, c in plan.items()])
    rows = rows.withColumn("__slice", F.conv(F.substring("__order", 1, 3), 16, 10).cast("int"))
    slices = rows.groupBy("__skey", "__slice").agg(F.first("__source").alias("source"), F.sum("__size").alias("slice_size"))
    shares = targets(slices.groupBy("__skey").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size")).select("source", "source_size"), weights, most)
    shares = shares.select(key(F.col("source")).alias("__skey"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("weight_no").alias("__weight_no"))
    earlier = W.partitionBy("__skey").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select("__skey", "__slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("__base")).join(shares, "__skey")
    rows = rows.join(slices, ["__skey", "__slice"])
    within = W.partitionBy("__skey", "__slice").orderBy("__order", "__id", "__size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__offset", F.col("__base") + F.coalesce(F.sum("__size").over(within), F.lit(0)))
    goal = F.floor("__target").cast("long")
    takes = F.array(*[F.greatest(F.lit(0), F.least(F.col("__size"), goal - F.col("__source_size") * k - F.col("__offset"))) for k in range(most)])
    rows = rows.withColumn("__takes", takes)
    share = [(F.col("__offset") + F.col("__source_size") * k + F.col("__takes")[k] / 2.0) / F.col("__target") for k in range(most)]
    when = lambda y: F.coalesce(*[F.when(F.col("__weight_no") == n, inverse_demand(y, s)) for n, s in enumerate(schedules)])
    positions = F.array_compact(F.array(*[F.when(F.col("__takes")[k] > 0, when(share[k])) for k in range(most)]))
    taken = sum((F.col("__takes")[k] for k in range(1, most)), F.col("__takes")[0])
    return rows.select(*quoted(keep), "__size", "__source_size", "__target", taken.alias("__taken"), positions.alias("__positions"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights=WEIGHTS, schedules=SCHEDULES, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs (columns `keep`) with size, source_size, target, taken and positions (array of double, one for each copy taken).

    size: words of the text, null: 0. taken: words of the document in the mix, repeats counted, `most` times its size at
    most; the document at the target's edge is taken in part. Each source's taken words are its target, rounded down.
    Null ids sort as empty ones; rows of equal ids follow each other by size. Empty tables give no rows. Columns of docs that
    have these names are replaced.
    """
    new = ["size", "source_size", "target", "taken", "positions"]
    rows = _plan(docs, [c for c in keep or docs.columns if c not in new], weights, schedules, most, id_col, text_col, source_col)
    return rows.withColumnsRenamed({f"__{c}": c for c in new})


def in_training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document, range-sorted by its first position (shown to 6 places); documents that the mix leaves out come last, by id."""
    first = F.get("positions", F.lit(0))
    return mixed.orderBy(first.asc_nulls_last(), id_col).withColumn("position", F.round(first, 6))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' own columns, a row for each copy (taken over size, to the nearest whole), in training order."""
    mixed = _plan(docs, docs.columns, weights, schedules, most, id_col, text_col, source_col)
    copies = F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.col("__size")).cast("int")).otherwise(0)
    rows = mixed.where(copies > 0).withColumn("__at", F.explode(F.slice("__positions", F.lit(1), copies)))
    return rows.repartitionByRange("__at").sortWithinPartitions("__at").select(*quoted(docs.columns))
