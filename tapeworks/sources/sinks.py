"""Writing tables, hourly partitions, summaries and dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_hourly(df: DataFrame, path: str) -> None:
    """Rows by feed, date and hour; an hour's rows meet in a task, and AQE splits the hours that are too many for one."""
    write_table(df.hint("rebalance", "feed", "date", "hour"), path, partition_by=["feed", "date", "hour"])


def write_verified(df: DataFrame, path: str) -> int:
    """Writes, then compares the number of rows read back with the number written (counted as they pass)."""
    from pyspark.sql import Observation

    seen = Observation("written")
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    back = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if back != seen.get["n"]:
        raise IOError(f"{path}: wrote {seen.get['n']} rows, read back {back}")
    return back


def write_stats(df: DataFrame, path: str) -> None:
    """Summary rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table's write has ended: Spark's marker file is there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def checkpointed(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table if its write has ended, else built, stored (over what a failed write left) and reread: what follows doesn't recompute it."""
    if not complete(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def missing_keys(needed: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return needed.select(key).distinct().join(dimension, key, "left_anti")


def upsert_dimension(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row a key; the new row wins whole."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, F.struct(*cols).alias("__n"))
    j = old.select(key, F.struct(*cols).alias("__o")).join(n, key, "full").withColumn("__r", F.coalesce("__n", "__o"))
    return j.select(key, "__r.*")


def merge_precedence(primary: DataFrame, fallback: DataFrame, key: str, source: str = "source") -> DataFrame:
    """One row a key (of both sides at most one): the primary's values, and the fallback's where those are null or there is no row; and where the row comes from."""
    cols = [c for c in primary.columns if c != key and c in fallback.columns]
    a = primary.select(key, F.struct(*cols).alias("__a"))
    b = fallback.select(key, F.struct(*cols).alias("__b"))
    j = a.join(b, key, "full")
    return j.select(key, *[F.coalesce(F.col(f"__a.{c}"), F.col(f"__b.{c}")).alias(c) for c in cols], F.when(F.col("__a").isNotNull(), "primary").otherwise("fallback").alias(source))


def rotate_completed(spark: SparkSession, source: str, target: str, schema: str, now_hour: str) -> None:
    """Landing JSON lines under date=/hour= of finished hours -> hourly Parquet of the same layout.

    Only the partitions present are overwritten, so a run again after a failure replaces what it left; the current hour and
    hours after it wait. The source stays as it is. Lines that are no JSON object are dropped here (read_jsonl counts them).
    """
    lines = spark.read.option("basePath", source).text(source)
    day = F.col("date").cast("string")
    hour = F.lpad(F.col("hour").cast("string"), 2, "0")
    done = lines.where(F.concat_ws("T", day, hour) < now_hour)
    out = done.where(F.expr("try_parse_json(value) is not null")).select(F.from_json("value", schema).alias("j"), day.alias("date"), hour.alias("hour")).select("j.*", "date", "hour")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "hour").option("compression", "zstd").parquet(target)
